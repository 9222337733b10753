"""Constants that results depend on, kept together as plain text."""

# Survey country codes and the code each is reported under.
COUNTRY_RECODES = {
    "TAP": "TWN",
    "QES": "ESP",
    "KSV": "KOS",
    "QAZ": "AZE",
    "QCI": "CHN",
    "QCN": "CHN",
    "QCH": "CHN",
    "QRT": "RUS",
    "YUG": "BIH",
    "QUR": "UKR",
    "QTN": "IND",
    "QVE": "VEN",
    "QMR": "RUS",
    "QUE": "USA",
    "QRS": "RUS",
    "QUC": "USA",
    "QAR": "ARG",
    "QHP": "IND",
    "QUD": "PRI",
    "ROM": "ROU",
}

# Income groups in display order.
INCOME_LEVELS = ("Low income", "Lower-middle income", "Upper-middle income", "High income")

# Quartile probabilities and band labels.
QUARTILES = (0.25, 0.5, 0.75)
QUARTILE_LABELS = ("Q1 (Bottom 25%)", "Q2 (25-50%)", "Q3 (50-75%)", "Q4 (Top 25%)")

# Plausible score range, both ends included.
SCORE_RANGE = (50.0, 1000.0)

# Percent of government funding above/below which a label is replaced.
PUBLIC_ABOVE = 80.0
PRIVATE_BELOW = 50.0

# Enrolment parity zone, both ends included, and the gap-axis floor.
PARITY_RANGE = (0.97, 1.03)
GAP_FLOOR = -10.0

# Cycles compared in the socio-economic gap report.
GAP_CYCLES = (2003, 2018, 2022)

# Rows of the six-number summary, in order.
SUMMARY_STATISTICS = ("Min.", "1st Qu.", "Median", "Mean", "3rd Qu.", "Max.")

# Predictors of the score models.
PREDICTORS = (
    "escs",
    "staff_shortage",
    "fund_gov",
    "school_size",
    "stratio",
    "GDP_per_PPP_2022",
    "gender_parity_index",
    "percentage_education_on_gdp",
)

# School columns of the modelling table.
SCHOOL_COLUMNS = (
    "enrol_boys",
    "enrol_girls",
    "stratio",
    "public_private",
    "staff_shortage",
    "fund_gov",
    "school_size",
)
