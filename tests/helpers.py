def rows(df):
    """Rows as a list of tuples in the frame's own order."""
    return [tuple(r) for r in df.collect()]


def row_set(df):
    return sorted(rows(df), key=repr)


def values(df, column):
    return [r[column] for r in df.collect()]
