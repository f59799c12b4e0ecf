"""Quality, line dedup, Jaccard join, decontamination and model scores against brute force and on odd rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, lines, lmscore, neardup, quality
from tessera.llm.common import shingle_sets, steps, text_bytes, words
from tessera.llm.tokens import default_path, token_ids

DOCS = "doc_id long, text string"
VOCABULARY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and blank texts, repeated rows, one id with two texts, a very long text, columns whose names clash."""
    rng = random.Random(5)
    same = prose(rng, 80)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, same), (4, same), (4, prose(rng, 70)), (None, same), (None, None), (5, prose(rng, 60_000)), (6, "word " * 20_000), (7, "x" * 200_000), (8, "one two"), (9, "One  TWO\n")]
    return spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("n", "key", "sid", "score", "n_lines", "th", "a", "image", "page_no")})


def test_words_are_split_and_lowered_bytewise():
    got = []
    for _, _, data, at in steps(pa.array(["A b\x0bc", "", None, "é É a"])):
        h, _, row = words(data, at)
        got += [h[row[i] : row[i + 1]].tolist() for i in range(len(row) - 1)]
    assert [len(x) for x in got] == [3, 0, 0, 3]
    assert got[0][0] == got[3][2] and got[3][0] != got[3][1]
    assert text_bytes(pa.array(["ab", "c"])[1:])[0].tobytes() == b"c"


# quality


def test_quality_learns_without_held_out_labels_and_handles_odd_rows(spark, odd):
    rng = random.Random(1)
    good = [(i, prose(rng, rng.randint(5, 300)).capitalize() + ".") for i in range(120)]
    bad = [(1000 + i, " ".join(w.upper() + "$$" for w in prose(rng, rng.randint(30, 200)).split())) for i in range(60)]
    docs = spark.createDataFrame(good + bad, DOCS)
    true = {i: int(i < 1000) for i, _ in good + bad}
    wrong = [(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in true.items()]  # held-out labels lie
    labels = spark.createDataFrame(wrong, "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [i for i in true if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and sum((got[i] >= 0.5) == bool(true[i]) for i in held) / len(held) > 0.95
    out = quality.score(odd, model)
    assert out.columns == [c for c in odd.columns if c != "score"] + ["score"]
    rows = out.collect()
    assert len(rows) == 13 and all(0 <= r.score <= 1 for r in rows)
    by = defaultdict(set)
    for r in rows:
        by[r.text or ""].add(r.score)
    assert all(len(s) == 1 for s in by.values())
    assert quality.score(docs.limit(0), model).count() == 0


def test_quality_without_usable_labels_is_constant(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, one)).collect()} == {1.0}


def test_quality_takes_whole_documents_within_its_bound(spark, monkeypatch):
    """All passages of a document are learnt from, or none, and its columns' names don't matter."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels, s: seen.append([len(b) for b in bags]))
    docs = spark.createDataFrame([(i, "word " * (64 * (i % 5 * 40 + 1))) for i in range(40)], DOCS).withColumn("quality", F.lit("x")).withColumn("size", F.lit("x"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for bound in (100_000, 500):
        quality.train(docs.drop("quality"), labels, quality.Settings(passages=bound))
    assert sum(seen[0]) > 1000 and max(seen[0]) == 161 and 300 < sum(seen[1]) <= 500 and set(seen[1]) <= {1, 41, 81, 121, 161}
    quality.train(docs, labels)
    assert seen[2] == seen[0]
    assert quality.train(docs.limit(0), labels) is None and seen[3] == []


def brute_scores(model, texts: list[str]) -> list[float]:
    """Encoder, attention and classifier word by word and passage by passage in plain Python."""
    w, out = model.weights, []
    for t in texts:
        raw, logits = [], []
        x, first = next((quality.passages(d, at) for _, _, d, at in steps(pa.array([t]))))
        assert first.tolist() == [0, max(1, -(-len(t.split()) // 64))]
        for row in x:
            v = [max(-6.0, min(6.0, (float(a) - float(b)) / float(c))) for a, b, c in zip(row, model.mean, model.spread, strict=True)]
            h = [math.tanh(sum(a * w["W"][k][i] for k, a in enumerate(v)) + w["b"][i]) for i in range(len(w["b"]))]
            gate = [math.tanh(sum(a * w["V"][k][i] for k, a in enumerate(h))) / (1 + math.exp(-sum(a * w["U"][k][i] for k, a in enumerate(h)))) for i in range(len(w["a"]))]
            raw.append(h)
            logits.append(sum(a * b for a, b in zip(gate, w["a"], strict=True)))
        e = [math.exp(a - max(logits)) for a in logits]
        z = [sum(a / sum(e) * h[i] for a, h in zip(e, raw, strict=True)) for i in range(len(w["c"]))]
        out.append(1 / (1 + math.exp(-sum(a * b for a, b in zip(z, w["c"], strict=True)) - w["d"][0])))
    return out


def test_quality_scores_against_brute_force_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.score(docs.select("doc_id", "text"), model, "s").collect()
    for r, want in zip(got[:25], brute_scores(model, [r.text or "" for r in got[:25]]), strict=True):
        assert r.s == pytest.approx(want, abs=1e-5)
    true = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.s >= quality.THRESHOLD) == bool(true[r.doc_id]) for r in got if r.doc_id in true and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and np.mean(held) > 0.9


def test_gradient_of_the_attention_model():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, quality.FEATURES), np.float32) for n in (1, 3, 2, 4)]
    for b in bags[:2]:
        b[0, 0] += 5  # one passage of a bag decides
    m = quality.fit(bags, np.array([1.0, 1.0, 0.0, 0.0]), quality.Settings(rounds=200))
    x, first = np.concatenate(bags), np.array([0, 1, 4, 6, 10])
    assert (m.scores(x, first) > 0.5).tolist() == [True, True, False, False]
    a = m.encode(x.astype(float), first)[4]
    assert np.allclose(np.add.reduceat(a, first[:-1]), 1)


# line dedup


def brute_lines(rows: list[tuple], least: int) -> dict:
    docs = sorted({(i, t or "") for i, t in rows if i is not None})
    seen, gone = set(), defaultdict(set)
    for key in docs:
        kept = [(p, x, len(words(*_one(x))[0])) for p, x in enumerate(key[1].split("\n"))]
        kept = [k for k in kept if k[2]]
        runs = set()
        for i in range(len(kept)):
            for order in (range(i, len(kept)), range(i, -1, -1)):
                total, j = 0, i
                for j in order:
                    total += kept[j][2]
                    if total >= least:
                        break
                if total >= least:
                    runs.add((min(i, j), max(i, j)))
        for a, b in sorted(runs):
            run = tuple(x for _, x, _ in kept[a : b + 1])
            if run in seen:
                gone[key].update(range(kept[a][0], kept[b][0] + 1))
            seen.add(run)
    return gone


def _one(text: str):
    return next(((d, at) for _, _, d, at in steps(pa.array([text]))), (np.zeros(0, np.uint8), np.zeros(1, np.int64)))


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(3)
    stock = [prose(rng, rng.randint(1, 9)) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice(stock) if rng.random() < 0.8 else rng.choice(["", prose(rng, 12)]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS), 12).collect()}
    want = brute_lines(rows, 12)
    for i, t in rows:
        cut = t.split("\n")
        left = [x for p, x in enumerate(cut) if p not in want[i, t]]
        assert out[i].n_removed == len(want[i, t]) and out[i].n_lines == len(cut)
        assert out[i].text == (t if not want[i, t] else "\n".join(left) if "".join(left).strip() else "")


def test_line_dedup_extends_matches_beyond_fingerprinted_runs(spark):
    """A run of 6 words, first seen in document 1, goes on alike in documents 2 and 3 for less than another run; only the extension finds that."""
    rows = [(1, "a b c\nd e f\nother"), (2, "x\na b c\nd e f\nlonger\n\nstill\nend"), (3, "y\na b c\nd e f\nlonger\nstill\nelse"), (4, "z w v u t s r\nlonger")]
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, DOCS), 6).collect()}
    assert out == {1: rows[0][1], 2: "x\nlonger\n\nstill\nend", 3: "y\nelse", 4: rows[3][1]}


def test_line_dedup_keeps_columns_of_any_name(spark):
    text = "\n".join(f"line {k} of some words here" for k in range(12))
    names = ("removed", "own_id", "own_th", "_th", "th", "row", "row_th", "n_lines", "first", "head")
    df = spark.createDataFrame([(1, text), (2, text)], DOCS).withColumns({c: F.lit(c) for c in names})
    rows = lines.dedup_lines(df, counts=("lines before", "lines out")).collect()
    assert {(r.doc_id, r.text != "", r["lines out"]) for r in rows} == {(1, True, 0), (2, False, 12)}
    assert all(r[c] == c for r in rows for c in names)


def test_line_dedup_of_odd_rows(spark, odd):
    out = lines.dedup_lines(odd)
    assert set(out.columns) == {*odd.columns, "n_removed"}
    rows = out.collect()
    assert len(rows) == 13
    nulls = [r for r in rows if r.text is None]
    assert len(nulls) == 2 and all(r.n_lines == 0 and r.n_removed == 0 for r in nulls)
    shared = [r for r in rows if r.doc_id == 4 and r.n_removed]
    assert len(shared) == 2 and {r.text for r in shared} == {""}  # the row without id comes first and keeps its text
    assert lines.dedup_lines(odd.limit(0)).count() == 0


# Jaccard join


def brute_groups(rows: list[tuple], k: int, percent: int) -> dict:
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[n + 1 :]:
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    rows = []
    for base in range(14):
        text = prose(rng, rng.choice([1, 3, 5, 9, 15, 40, 120, 400])).split()
        for _ in range(rng.randint(1, 9)):
            copy = text[:]
            for _ in range(rng.randint(0, max(1, len(text) // 25))):
                p = rng.randrange(len(copy) or 1)
                copy[p : p + rng.randint(0, 1)] = [rng.choice(VOCABULARY)] * rng.randint(0, 1)
            rows.append((len(rows), " ".join(copy)))
    for least in (1, 40):  # with the rounds of best partners and without
        got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), neardup.Join(words=k, percent=percent, rounds=least % 40, chunk=4))
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_groups(rows, k, percent)


def test_tiles_of_linked_sets_always_meet():
    """Random pairs at every distance up to the limit, and pairs whose elements crowd in a few parts, so that many are empty."""
    rng = np.random.default_rng(1)
    checked = 0
    for percent in (80, 85):
        j = neardup.Join(words=4, percent=percent)
        for n in [4, 5, 6, 7, 9, 12, 13, 17, 18, 30, 47, 52, 90, 200, 201, 700, 3000]:
            for k in range(30):
                wide = 2**64 if k % 3 else 2 ** int(rng.integers(58, 64))
                a = np.unique(rng.integers(0, wide, n, dtype=np.uint64))
                drop = int(rng.integers(0, n * (100 - percent) // 100 + 1))
                more = int((n - drop) * 100 / percent - n)
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, wide, max(0, more), dtype=np.uint64)]))
                if neardup.linked(a, b, percent) and not np.array_equal(a, b):
                    checked += 1
                    assert np.intersect1d(neardup.tile_keys(a, j), neardup.tile_keys(b, j)).size
                    x, y = neardup.parity_bits(a), neardup.parity_bits(b)
                    size = min(len(x), len(y))
                    assert neardup.may_link(len(a), len(b), int(np.bitwise_count(neardup.fold(x, size) ^ neardup.fold(y, size)).sum()), percent)
    assert checked > 600


def test_jaccard_join_of_rows_without_id_and_of_hot_tiles(spark):
    """Many different texts with one id or none, near copies of one text (one hot tile), and one passage in texts that do not link."""
    rng = random.Random(6)
    base, passage = prose(rng, 60).split(), prose(rng, 40)
    rows: list[tuple] = [(None if k % 2 else 7, f"{prose(rng, 30)} {k}") for k in range(60)]
    near = [" ".join([*base[:20], f"x{k}", *base[21:]]) for k in range(150)]
    rows += [(100 + k, t) for k, t in enumerate(near)] + [(300 + k, f"{passage} {prose(rng, 25)}") for k in range(60)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOCS), neardup.Join(chunk=16)).collect()
    want = brute_groups([(i, t) for i, t in rows if i is not None and i >= 100], 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id and r.doc_id >= 100} == want
    assert Counter((r.doc_id, r.component_id) for r in got if r.doc_id in (None, 7)) == {(None, None): 30, (7, 7): 30}
    assert len({c for i, (_, c) in want.items() if i < 300}) == 1 and len({c for i, (_, c) in want.items() if i >= 300}) == 60


def test_jaccard_join_of_odd_rows(spark, odd):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == 13
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id))
    assert by[1] == [(0, 1)] and by[2] == [(0, 2)] and by[3] == [(0, 3)]
    assert by[8] == [(1, 8)] and by[9] == [(1, 8)]
    assert sorted(by[4])[-1] == (76, 4) and (76, 4) in by[None] and (0, None) in by[None]
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


# decontamination


def brute_distance(item: list, text: list) -> int:
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row = row, [i]
        for j, y in enumerate(text, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return min(row)


def test_edit_distance_to_any_run_of_words():
    rng = random.Random(2)
    for _ in range(150):
        a = [rng.randint(0, 4) for _ in range(rng.randint(1, 80))]
        b = [rng.randint(0, 4) for _ in range(rng.randint(0, 100))]
        assert decontaminate.nearest(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute_distance(a, b)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 7, 8, *(rng.randint(8, 45) for _ in range(10))])]
    rows, planted = [], set()
    for d in range(240):
        w = prose(rng, rng.randint(0, 150)).split()
        if d % 2 == 0:
            i, t = items[d // 2 % len(items)]
            t = t.upper().split()
            for _ in range(rng.randint(0, len(t) * 15 // 100)):
                p = rng.randrange(len(t))
                t[p : p + rng.randint(0, 1)] = ["edited"] * rng.randint(0, 1)
            p = rng.randint(0, len(w))
            w[p:p] = t
        rows.append((d, " ".join(w)))
    seven = next(t.split() for i, t in items if i == 6)
    rows.append((240, " ".join(["intro", *seven[:3], "changed", *seven[4:], "outro", *seven])))  # the nearest of two places is the later one
    rows.append((241, " ".join(["intro", *seven[:3], "changed", *seven[4:]])))
    lower = {i: t.lower().split() for i, t in items}
    for d, t in rows:
        for i, x in lower.items():
            if brute_distance(x, t.lower().split()) <= len(x) * 15 // 100:
                planted.add((d, i))
    docs, table = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    seen = []
    for parts, search in ((1, {}), (50, {}), (3, {"slice_bytes": 600}), (1, {"batch": 1})):
        found = decontaminate.contaminated(docs.repartition(parts), table, decontaminate.Search(**search)).collect()
        seen.append(sorted(map(tuple, found)))
    assert all(x == seen[0] for x in seen)  # neither partitions nor batches nor slices matter
    got = {(r[0], r[1]) for r in seen[0]}
    assert got <= planted and len(got) >= 0.95 * len(planted) and len(planted) > 100
    assert {(d, i) for d, i in planted if len(lower[i]) <= 7} <= got
    texts = dict(rows)
    for d, i, distance, _, first, last in seen[0]:
        cut = texts[d].lower().split()
        assert brute_distance(lower[i], cut[first : last + 1]) == distance == brute_distance(lower[i], cut) or len(lower[i]) > 7
    assert [r[2:] for r in seen[0] if r[:2] == (240, 6)] == [(0, 7, 9, 15)]
    assert [r[2:] for r in seen[0] if r[:2] == (241, 6)] == [(1, 7, 1, 7)]


def test_recall_at_the_greatest_distance():
    rng = np.random.default_rng(9)
    index = decontaminate.Index([(i, rng.integers(1, 2**62, int(n), dtype=np.uint64)) for i, n in enumerate(rng.integers(20, 50, 60))], decontaminate.Search())
    found = total = 0
    for group in (g for *_, g, _, _, _ in index.sizes.values()):
        for key, x in group:
            y = x.copy()
            y[rng.choice(len(y), len(y) * 15 // 100, replace=False)] = rng.integers(1, 2**62)
            h = np.concatenate([rng.integers(1, 2**62, 40, dtype=np.uint64), y, rng.integers(1, 2**62, 40, dtype=np.uint64)])
            found += any(k == key for _, k, *_ in index.find([(h, index.hits(h))]))
            total += 1
    assert found / total >= 0.9


def test_decontamination_of_odd_rows(spark, odd):
    item = odd.filter("doc_id = 4").select("text").first().text
    items = spark.createDataFrame([(1, " ".join(item.split()[10:40])), (2, None), (3, "one two"), (None, "word word word word word")], "item_id long, text string")
    rows = decontaminate.contaminated(odd, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in rows) == {(4, 1): 2, (None, 1): 1, (6, None): 1, (8, 3): 1, (9, 3): 1}
    assert decontaminate.contaminated(odd.limit(0), items).count() == 0
    assert decontaminate.contaminated(odd, items.limit(0)).count() == 0


# model scores


def test_scores_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 25)) if i % 3 else "la la " * rng.randint(1, 9)) for i in range(40)]
    targets = {i for i in range(40) if i % 3 == 0 and i % 2 == 0}
    path, m = default_path(), lmscore.Models()
    ids = {i: [-1, *token_ids(t, path).tolist()] for i, t in rows}
    pair = {c: Counter() for c in "tb"}
    for i, x in ids.items():
        for c in "tb" if i in targets else "b":
            pair[c].update(zip(x, x[1:], strict=False))
    for rows_held in (lmscore.Models(), lmscore.Models(part_tokens=30)):
        got = {r.doc_id: r for r in lmscore.cross_entropy_difference(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(i,) for i in targets], "doc_id long"), m=rows_held).collect()}
        for i, x in ids.items():
            loss = {}
            for c in "tb":
                one, over = Counter(), Counter()
                for (h, w), n in pair[c].items():
                    one[w] += n
                    over[h] += n
                own = Counter(zip(x, x[1:], strict=False)) if c == "b" or i in targets else Counter()
                heads = Counter()
                for (h, _), n in own.items():
                    heads[h] += n
                size = len({w for _, w in pair["b"]})
                total = sum(one.values()) + m.alpha * size
                loss[c] = -np.mean([np.log((pair[c][h, w] - own[h, w] + m.mu * (one[w] + m.alpha) / total) / (over[h] - heads[h] + m.mu)) for h, w in zip(x, x[1:], strict=False)])
            assert got[i].n_tokens == len(x) - 1
            assert got[i].target_loss == pytest.approx(loss["t"], abs=1e-5) and got[i].background_loss == pytest.approx(loss["b"], abs=1e-5)
    assert np.mean([got[i].score for i in ids if i % 3 == 0]) < np.mean([got[i].score for i in ids if i % 3])


def test_scores_of_odd_rows(spark, odd):
    small = odd.filter("doc_id IS NULL OR doc_id NOT IN (5, 7)")
    rows = lmscore.cross_entropy_difference(small, spark.createDataFrame([(4,), (None,), (4,)], "doc_id long")).collect()
    assert len(rows) == 11 and all(r.score == 0 for r in rows if r.n_tokens == 0)
    assert lmscore.cross_entropy_difference(odd.limit(0), odd.limit(0)).count() == 0


def test_shingles_of_short_texts():
    sets = [s for _, _, d, at in steps(pa.array(["a b c", "A  b\tc", "a b", "", "a b c d", "a b c d a b c d"])) for s in shingle_sets(d, at, 4)]
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1, 4] and sets[0] == sets[1] != sets[2]


def test_decontamination_does_not_look_at_signs_and_case(spark):
    item = "The quick brown fox jumps over the lazy dog, again and again."
    docs = spark.createDataFrame([(1, "intro the quick brown fox jumps over the lazy dog again and AGAIN!!! outro"), (2, "the quick brown cat sits under a busy dog again and again and so on")], DOCS)
    rows = decontaminate.contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance, r.first_word, r.last_word) for r in rows] == [(1, 7, 0, 1, 12)]
