"""The pipeline's stages against brute force, and on null, empty, repeated and very long rows, no rows and clashing names."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, quality
from tessera.llm.common import steps
from tessera.llm.tokens import default_path, token_ids

from .test_format_operators import check_pieces
from .test_text_operators import DOCS, brute_distance, brute_groups, brute_lines, prose

pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


def tables(spark, where, items: list[str], labels: list[tuple]) -> str:
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def fixture_rows() -> tuple[list, list, list]:
    """Documents (good and bad, with repeated runs of lines, near copies and benchmark passages), items and labels."""
    rng = random.Random(11)
    items = [prose(rng, n) for n in (20, 26, 33)]
    run = "\n".join(prose(rng, 11) + "." for _ in range(6))
    texts = []
    for k in range(70):
        text = [prose(rng, 14).capitalize() + "." for _ in range(rng.randint(3, 9))]
        if k % 7 == 1:
            text.insert(rng.randint(0, len(text)), run)
        if k % 9 == 2:
            w = items[k % 3].split()
            w[rng.randrange(len(w))] = "edited"
            text.insert(rng.randint(0, len(text)), " ".join(w))
        texts.append("\n".join(text))
        if k % 5 == 0:
            w = texts[-1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    bad = [" ".join(w.upper() + "$$$" for w in prose(rng, 60).split()) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts + bad)]
    labels = [(i, int(i < len(texts))) for i, _ in rows]
    return rows, items, labels


def brute_decontaminated(rows: list[tuple], items: list[str]) -> list[tuple]:
    plain = lambda t: ["".join(c for c in w if c.isalnum() or ord(c) > 126) for w in t.lower().split()]
    return [(i, t) for i, t in rows if all(brute_distance(plain(x), plain(t or "")) > len(x.split()) * 15 // 100 for x in items)]


def test_every_stage_against_brute_force(spark, tmp_path):
    rows, items, labels = fixture_rows()
    sf = tables(spark, tmp_path, items, labels)
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text"))
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))

    def scored(text: str) -> float:
        return float(next(model.scores(*quality.passages(d, at))[0] for _, _, d, at in steps(pa.array([text]))))

    want = [[(i, t) for i, t in rows if scored(t) >= quality.THRESHOLD]]
    gone = brute_lines(want[0], 50)
    cut = [(i, t, [x for p, x in enumerate(t.split("\n")) if p not in gone[i, t]] if gone[i, t] else None) for i, t in want[0]]
    cut = [(i, t if left is None else "\n".join(left) if "".join(left).strip() else "", left is not None) for i, t, left in cut]
    want.append([(i, t) for i, t, changed in cut if t or not changed])
    groups = brute_groups(want[1], 5, 80)
    want.append([(i, t) for i, t in want[1] if groups[i][1] == i])
    want.append(brute_decontaminated(want[2], items))
    assert len(rows) > len(want[0]) >= len(want[1]) > len(want[2]) > len(want[3]) > 30 and any(gone.values())
    for (name, stage), expected in zip(pipeline.STAGES, want, strict=False):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert sorted((r.doc_id, r.text) for r in got) == sorted(expected), name
        assert all(r.n_chars == len(r.text) for r in got)
        docs = spark.createDataFrame(got, docs.schema)
    ids = {i: np.append(token_ids(t, default_path()), np.uint32(0)) for i, t in want[3]}
    check_pieces(pipeline.STAGES[-1][1](spark, docs, sf).collect(), ids, packing.PRODUCTION)


def test_run_chains_the_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, SMALL), name.replace(" ", "-"))
    ids = {r.doc_id: np.append(token_ids(r.text or "", default_path()), np.uint32(0)) for r in docs.collect()}
    rows = pipeline.run(spark, SMALL).collect()
    check_pieces(rows, ids, packing.PRODUCTION)
    assert {r.doc_id for r in rows} == set(ids)


CLASHES = ("score", "row", "key", "th", "removed", "own_id", "_gone", "n_lines", "n_before", "n_out", "component_id", "ids", "p", "sid")


def test_stages_on_odd_rows_and_clashing_names(spark, tmp_path):
    rng = random.Random(12)
    item, long = prose(rng, 25), prose(rng, 30_000)
    sf = tables(spark, tmp_path, [item], [(1, 1), (2, 0), (3, 1)])
    other = prose(rng, 40)
    rows = [(1, None), (2, ""), (3, " \n"), (4, other), (4, other), (4, item), (None, item), (None, other), (None, None), (5, long), (6, prose(rng, 30) + " " + item), (7, "one")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(c) for c in CLASHES})
    want = Counter(rows)
    survivors = {
        "line dedup": want,
        "n-gram Jaccard join": Counter([r for r in set(rows) if r not in ((None, other), (None, item))]),
        "benchmark decontamination": Counter({r: n for r, n in want.items() if item not in (r[1] or "")}),
    }
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        got = out.collect()
        assert out.columns == docs.columns and all(r[c] == c for r in got for c in CLASHES), name
        if name in survivors:
            assert Counter((r.doc_id, r.text) for r in got) == survivors[name], name
        else:
            assert set((r.doc_id, r.text) for r in got) <= set(rows)
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    packed = pipeline.packing(spark, docs, sf).collect()
    assert sum(r.length for r in packed) == sum(len(token_ids(t or "", default_path())) + 1 for _, t in rows)
    assert pipeline.packing(spark, docs.limit(0), sf).count() == 0


def test_near_duplicate_stage_keeps_one_of_repeated_rows(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(2, text), (1, text), (1, text), (3, "another text of some more words here"), (4, None), (4, None), (None, text)], DOCS)
    rows = pipeline.near_dup(spark, docs, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 3), (False, 4)]


def test_pipeline_decontaminates_rows_not_ids(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(1, item), (1, "clean one"), (None, item), (None, "clean two")], DOCS)
    assert {(r.doc_id, r.text) for r in pipeline.decontamination(spark, docs, SMALL).collect()} == {(1, "clean one"), (None, "clean two")}
