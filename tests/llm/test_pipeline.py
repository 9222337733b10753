"""The pipeline's stages against brute force, each on what the one before kept."""

import sys
from pathlib import Path

from test_near_dedup import brute_force as all_pairs
from test_pieces import plain_search
from test_repeats import brute_force as all_windows

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from weighbridge.llm import decontaminate, pieces, quality  # noqa: E402


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {"documents": docs}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, at, sf).write.parquet(str(tmp_path / name))
        kept[name] = at = spark.read.parquet(str(tmp_path / name))
        if name != "pieces":
            assert at.columns == docs.columns and at.dtypes == docs.dtypes

    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.score >= corpus_pipeline.QUALITY_THRESHOLD}
    assert sorted(rows(kept["quality"])) == sorted(r for r in rows(docs) if r[0] in good)

    before = rows(kept["quality"])
    groups = all_pairs(before, 5, 80)
    assert sorted(rows(kept["near_dedup"])) == sorted(r for r in before if groups[r[0]][2])

    before = rows(kept["near_dedup"])
    removed = {r[0]: r[2] for r in all_windows(before, corpus_pipeline.REPEAT_BYTES, True)}
    after = dict(rows(kept["repeats"]))
    assert set(after) == {i for i, _ in before}
    for i, text in before:
        assert len(text.encode()) - len(after[i].encode()) in range(removed[i], removed[i] + 7)
        if removed[i] == 0:
            assert after[i] == text
    assert all(r.n_chars == len(r.text) for r in kept["repeats"].collect())

    items = [decontaminate._FOLD[list(r.text.encode())].tobytes().strip() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    folded = {i: decontaminate._FOLD[list(t.encode())].tobytes() if t else b"" for i, t in after.items()}
    clean = {i for i, t in folded.items() if not any(x in t for x in items)}
    left = {i for i, _ in rows(kept["decontamination"])}
    assert left <= clean
    found = decontaminate.contaminated(kept["repeats"], spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    assert left == set(after) - {r.doc_id for r in found}

    loaded = pieces.load()
    texts = dict(rows(kept["decontamination"]))
    for r in kept["pieces"].limit(20).collect():
        assert r.ids == plain_search(loaded, texts[r.doc_id]) and r.n_pieces == len(r.ids)


def test_odd_rows_pass_every_stage(spark, sf):
    ddl = "doc_id long, text string, lang string, source string, n_chars long, node string, spans int, v long"
    data = [(1, None, "en", None, None, "x", 1, 1), (2, "", None, "s", 0, "x", 1, 1), (None, "some text of a row without id", "en", "s", 29, "x", 1, 1),
            (3, "a plain text " * 3, "en", "s", 39, "x", 1, 1), (3, "a plain text " * 3, "en", "s", 39, "x", 1, 1), (4, "y" * 50_000, "en", "s", 50_000, "x", 1, 1)]
    for frame in (spark.createDataFrame(data, ddl), spark.createDataFrame([], ddl)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, sf)
            assert name == "pieces" or out.columns == frame.columns
            assert out.count() <= frame.count()
