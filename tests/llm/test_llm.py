"""Operators for training data against brute force, with null, empty, repeated and odd rows."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clusters, mixing, runs, spans, splits, tokens
from tidemark.llm.components import components

T0 = dt.datetime(2024, 1, 1)


# ---------------------------------------------------------------- components and splits


def test_components_against_union_find(spark):
    r = random.Random(1)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, k) for k in range(301, 330)] + [(5, 5), (None, 3), (7, None)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {n: root for n, root in (tuple(x) for x in components(spark.createDataFrame(edges, "a long, b long")).collect())}
    assert got == {n: find(n) for n in parent}


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


RECS = "id long, source_file string, loaded_at timestamp, root string"
NOTES = "id long, recording_id long, parent_annotation_id long, deleted_at string, loaded_at timestamp"


def test_groups(spark, rows):
    recs = [(1, "X_fs1.mat"), (2, "raw/x_fs2.NPY "), (3, "0.05_percent_X_fs1.mat"), (4, None), (5, None), (6, "y_fs1.mat"), (7, "z_fs1.mat"), (8, "w.mat"), (6, "y_fs1.mat")]
    notes = [(10, 6, None, None), (11, 7, 10, None), (12, 8, 11, "2024-01-01"), (13, 4, 99, None), (14, 5, 14, None), (15, 77, 10, None), (16, None, 10, None), (11, 7, 10, None)]
    a = spark.createDataFrame([(*x, T0, "extra") for x in recs], RECS)
    b = spark.createDataFrame([(*x, T0) for x in notes], NOTES)
    assert rows(splits.grouped(a, b)) == [(1, 2), (1, 3), (6, 7)]
    assert splits.grouped(a.limit(0), b.limit(0)).count() == 0
    targets = spark.createDataFrame([("train", 0.6), ("test", 0.4), (None, 0.1)], "split_name string, target_share double")
    out = splits.assign(a, b, targets)
    split = {(r.row_table, r.row_id): r.split_name for r in out.collect()}
    assert len(split) == out.count() == 8 + 7
    assert split["recordings", 1] == split["recordings", 2] == split["recordings", 3]
    assert split["recordings", 6] == split["recordings", 7] == split["annotations", 10]
    report = {r.split_name: r.actual_share for r in splits.split_report(out, targets).collect() if r.split_name}
    assert abs(report["train"] - 0.6) < 0.07


def test_shares_hold_at_every_size():
    for sizes in ({1: 5_000_000}, {1: 42_000_000}, {1: 20_000_000, 3: 2_000_000, 50: 100_000, 7777: 300, 3_000_000: 1, 900_000: 1}, {2: 4_000_001}, {1_000_000: 7, 1: 3}):
        total = sum(size * n for size, n in sizes.items())
        dealt = splits.deal(sizes, [("train", 0.8), ("val", 0.1), ("test", 0.1)])
        for name, share in (("train", 0.8), ("val", 0.1), ("test", 0.1)):
            assert abs(sum(size * n for size, n in dealt[name].items()) - share * total) <= 1.5 * max(sizes)
        assert all(sum(d.get(size, 0) for d in dealt.values()) == n for size, n in sizes.items())
    assert all(sum(s * n for s, n in d.items()) == t for d, t in zip(splits.deal({1: 42_000_000}, [("a", 0.8), ("b", 0.1), ("c", 0.1)]).values(), (4_200_000, 4_200_000, 33_600_000)))


def test_split_queries_by_value(spark, data):
    from tidemark.llm import queries

    rows = queries.p2_splits(spark, data).toPandas()
    assert not rows.duplicated(["row_table", "row_id"]).any()
    for table in ("recordings", "annotations"):
        ids = {r[0] for r in spark.read.parquet(f"{data}/{table}.parquet").select("id").distinct().collect() if r[0] is not None}
        assert set(rows.row_id[rows.row_table == table]) == ids
    assert rows.groupby("group_key").split_name.nunique().max() == 1
    targets = {r.split_name: r.target_share for r in spark.read.parquet(f"{data}/split_targets.parquet").collect()}
    size, left = rows.group_key.value_counts().tolist(), len(rows)
    got = rows.split_name.value_counts().to_dict()
    for name in sorted(targets, key=lambda n: (targets[n], n))[:1]:  # the first split is the best of all choices
        reach = 1
        for n in size:
            reach |= reach << n
        goal = round(targets[name] * left)
        assert abs(got.get(name, 0) - goal) == min(abs(t - goal) for t in range(left + 1) if reach >> t & 1)
    report = {r.split_name: r for r in queries.p2_report(spark, data).collect()}
    assert {n: r.n_recordings + r.n_annotations for n, r in report.items()} == {n: got.get(n, 0) for n in targets}
    assert all(abs(r.actual_share - got.get(n, 0) / left) < 1e-9 for n, r in report.items())
    found = queries.p2_found(spark, data).collect()
    key = rows[rows.row_table == "recordings"].set_index("row_id").group_key.to_dict()
    assert found and all(key[r.group_id] == key[r.recording_id] for r in found)


@pytest.mark.parametrize("seed", range(6))
def test_subset_counts_is_optimal(seed):
    r = random.Random(seed)
    mult = {r.randrange(1, 15): r.randrange(1, 4) for _ in range(4)}
    target = r.randrange(0, 40)
    totals = {0}
    for size, n in mult.items():
        totals = {t + size * k for t in totals for k in range(n + 1)}
    got = splits.subset_counts(mult, target)
    assert all(n <= mult[s] for s, n in got.items())
    assert abs(sum(s * n for s, n in got.items()) - target) == min(abs(t - target) for t in totals)


def test_deal_counts_true_totals_of_large_inputs():
    sizes = {1: 500_000, 3: 900_000, 5: 200_000, 700: 900}
    total = sum(s * n for s, n in sizes.items())
    assert total > 1 << 22
    got = splits.deal(sizes, [("train", 0.8), ("test", 0.1), ("val", 0.1)])
    for name in ("test", "val"):
        assert sum(s * n for s, n in got[name].items()) == round(total * 0.1)
    assert all(sum(g.get(s, 0) for g in got.values()) == n for s, n in sizes.items())


# ---------------------------------------------------------------- runs


def brute_runs(symbols, t):
    out, start, anchor = [], 0, None
    for i, s in enumerate(symbols):
        s = -1 if s is None else s
        if s == -1:
            continue
        if anchor is None:
            anchor = s
        elif abs(s - anchor) > t:
            out.append((start, i - 1))
            start, anchor = i, s
    return out + [(start, len(symbols) - 1)] if symbols else []


def test_runs_against_brute_force(spark):
    r = random.Random(4)
    seqs = {f"s{k}": (r.choice([3, 5, 6, 20]), [r.choice([-1, 0, 1, 1, 2, 3]) for _ in range(r.randrange(0, 30))]) for k in range(60)}
    seqs |= {"w": (3, [-1, -1, -1]), "none": (3, None), "nulls": (8, [None, 1, None, 2, 5]), "long": (8, [i // 1000 for i in range(20000)]), "alpha": (None, [1, 2, 1])}
    data = [(k, a, 10, s, T0, "x") for k, (a, s) in seqs.items()] * 2 + [(None, 3, 1, [1, 1], T0, "x")]
    df = spark.createDataFrame(data, "seed_id string, alphabet_size int, scale int, symbols array<int>, loaded_at timestamp, pos string")
    got = defaultdict(list)
    for row in runs.runs(df).collect():
        got[row.seed_id].append((row.first_pos, row.last_pos))
        assert row.n == row.last_pos - row.first_pos + 1 and row.duration == 10 * row.n
    assert {k: sorted(v) for k, v in got.items()} == {k: brute_runs(s, 1 if (a or 0) > 5 else 0) for k, (a, s) in seqs.items() if s}
    assert runs.runs(df.limit(0)).count() == 0


# ---------------------------------------------------------------- clusters


def brute_clusters(points, eps):
    ids = sorted(points)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(points[a]) == len(points[b]) and np.linalg.norm(np.array(points[a]) - np.array(points[b])) <= eps:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_a_row_is_once_in_a_cell():
    tree = clusters.Tree(np.zeros((0, 2)), 0, 0.25)
    tree.nodes, tree.width, tree.axes = [(0, 0.0, 1, 2), (), ()], 1.0, np.array([[0.0], [1.0]])
    row, key = tree.place(np.array([[0.0, 1.9], [0.0, 0.5]]))  # leaves 1 and 2, cells 1 and 2 of the first row
    assert len(set(zip(row.tolist(), key.tolist()))) == len(row) == 6
    assert [len(v) for v in tree.place(np.zeros((0, 2)))] == [0, 0]


WINDOWS = "window_id long, features array<double>, label int, loaded_at timestamp"


@pytest.mark.parametrize("chunk,per_cell", [(8192, 2048), (16, 8), (4, 4)])
def test_clusters_against_brute_force(spark, monkeypatch, chunk, per_cell):
    monkeypatch.setattr(clusters, "PER_CELL", per_cell)
    monkeypatch.setattr(clusters, "LEAF", 5)
    r = np.random.default_rng(chunk)
    centres = r.normal(size=(12, 5)) * 1.5
    points = {}
    for k in range(220):
        c = centres[int(len(centres) * r.random() ** 3)]
        points[k] = (c + r.normal(size=5) * 0.06).tolist()
    for k in range(220, 300):
        points[k] = (r.normal(size=5) * 1.2).tolist()
    for k in range(300, 340):  # a chain, far longer than it is wide
        points[k] = [4 + 0.2 * (k - 300), 4.0, 4.0, 4.0, 4.0]
    points[400] = points[401] = [9.0] * 5
    points[402] = [9.0, 9.0]
    bad = [(500, None), (501, [float("nan")] * 5), (502, [1.0, None, 1.0, 1.0, 1.0]), (503, []), (504, [float("inf")] * 5), (None, points[0])]
    data = [(i, p, 1, T0) for i, p in points.items()] + [(i, p, 1, T0) for i, p in bad] + [(0, points[0], 1, T0 + dt.timedelta(1))]
    df = spark.createDataFrame(data, WINDOWS).withColumn("cell", F.lit(1))
    labels = clusters.cluster(df, chunk=chunk)
    want = brute_clusters(points, 0.25)
    assert {r.window_id: r.cluster_id for r in labels.collect()} == want
    size = Counter(want.values())
    for row in clusters.describe(df, labels).collect():
        members = [i for i in want if want[i] == row.first_window_id]
        assert row["size"] == size[row.first_window_id]
        x = np.array([points[i] for i in members])
        cost = np.round(((x - x.mean(0)) ** 2).sum(1), 9)
        assert list(row.typical) == [members[i] for i in np.lexsort((members, cost))[:3]] and row.medoid == row.typical[0]


def test_a_crowded_cell_is_covered_level_by_level(spark):
    r = np.random.default_rng(5)
    for n in (100, 200):
        x = np.r_[r.normal(size=(n, 3)) * 0.01, r.normal(size=(n // 2, 3)) * 0.01 + [0.5, 0, 0], [[0.25, 0, 0]] * 10, r.normal(size=(10, 3)) * 0.01 + [0.9, 0, 0]]
        df = spark.createDataFrame([(k, row.tolist(), 1, T0) for k, row in enumerate(x)], WINDOWS)
        heads = df.select(F.lit(1).cast("long").alias("cell"), F.lit(3).alias("d"), F.col("window_id").alias("pivot"), F.col("features").cast("array<double>").alias("features"))
        tops, pairs, sure = clusters.covered_levels(heads, 0.25, 16, "array<double>")
        assert tops.count() == len(x) and tops.select("top").distinct().count() <= 16 and sure.count() <= 2 * len(x) and pairs.count() <= 120
        labels = {c.window_id: c.cluster_id for c in clusters.cluster(df, chunk=16).collect()}
        assert labels == brute_clusters(dict(enumerate(x.tolist())), 0.25)


@pytest.mark.parametrize("least", [0.24, 0.26])
def test_crowded_balls_that_hardly_touch(spark, least):
    """Two crowded groups whose only link, if any, is between members far from both pivots."""
    r = np.random.default_rng(1)
    a, b = r.uniform(-0.1, 0.1, (80, 2)), r.uniform(-0.1, 0.1, (80, 2))
    b[:, 0] += a[:, 0].max() - b[:, 0].min() + least
    b[:, 1] += a[a[:, 0].argmax(), 1] - b[b[:, 0].argmin(), 1]
    points = dict(enumerate(np.r_[a, b].tolist()))
    df = spark.createDataFrame([(k, p, 1, T0) for k, p in points.items()], WINDOWS)
    got = {c.window_id: c.cluster_id for c in clusters.cluster(df, chunk=8).collect()}
    assert got == brute_clusters(points, 0.25) and len(set(got.values())) == (1 if least < 0.25 else 2)


def test_tree_puts_alike_vectors_into_one_cell():
    r = np.random.default_rng(6)
    x = np.r_[r.normal(size=(3000, 4)), r.normal(size=(600, 4)) * 0.1 + 3]
    tree = clusters.Tree(x[::3], 50 * len(x), 0.1)
    row, key = tree.place(x)
    assert len(tree.nodes) > 9 and len(row) < 3 * len(x) and len(np.unique(key)) > 5
    cells = defaultdict(set)
    for i, k in zip(row.tolist(), key.tolist()):
        cells[i].add(k)
    i, j, _ = clusters.near_pairs(x, x, 0.01, True)
    assert len(i) > 100 and all(cells[a] & cells[b] for a, b in zip(i.tolist(), j.tolist()))
    flat = clusters.Tree(np.zeros((500, 4)), 10**6, 0.1)
    assert len(flat.nodes) == 1 and len(flat.place(np.zeros((7, 4)))[0]) == 7


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([], WINDOWS)
    assert clusters.cluster(df).count() == 0
    one = spark.createDataFrame([(5, [1.0, 2.0], 1, T0)], WINDOWS)
    assert [tuple(r) for r in clusters.cluster(one).collect()] == [(5, 5)]


# ---------------------------------------------------------------- tokens

ODD = ["a", "b", " ", "  ", "\n", "'s", "'", "ll", "1", "23", "é", "信", "號", "!", "?", "'re", "\t", " ", "😀", "é", "​", "'v", "<|endoftext|>", "\x00"]


def test_decoding_gives_the_text_back():
    r = random.Random(6)
    for piece in (1, 3, 1 << 12):
        encoder = tokens.Encoder(tokens.vocabulary(), piece=max(piece, 3))
        encoder.piece = piece if piece > 1 else 1
        for n in (0, 1, 5, 60, 400):
            text = "".join(r.choice(ODD) for _ in range(n))
            assert encoder.decode(encoder.bpe.encode_ordinary(text)) == text


@pytest.mark.parametrize("piece", [3, 7, 20])
def test_tree_equals_whole(piece):
    whole, tree = tokens.Encoder(tokens.vocabulary()), tokens.Encoder(tokens.vocabulary(), piece=piece)
    r = random.Random(piece)
    for _ in range(400):
        text = "".join(r.choice(ODD) for _ in range(r.randrange(0, 80)))
        ids = tree.encode(text)
        assert ids == whole.bpe.encode_ordinary(text) and whole.bpe.decode(ids) == text
    for text in (" " * 500 + "x", "ab" * 400, "x" + "\n" * 300):
        assert tree.encode(text) == whole.bpe.encode_ordinary(text)


def test_ids_equal_the_other_library(spark, data):
    tok = pytest.importorskip("tokenizers").Tokenizer.from_file(tokens.TOKENIZERS + "/byte_bpe_50k.json")
    tok.encode_special_tokens = True
    docs = [(1, None), (2, ""), (3, "<|endoftext|> it's"), (4, "  \n"), (5, "word " * 40000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(0))
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert got == {i: tok.encode(t, add_special_tokens=False).ids if t else [] for i, t in docs}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


# ---------------------------------------------------------------- mixing


def brute_sainte_lague(weights, seats, caps):
    out = [0] * len(weights)
    for _ in range(seats):
        open_ = [(w / (2 * n + 1), -k) for k, (w, n, c) in enumerate(zip(weights, out, caps)) if n < c and w > 0]
        if not open_:
            break
        out[-max(open_)[1]] += 1
    return out


@pytest.mark.parametrize("seed", range(8))
def test_sainte_lague(seed):
    r = random.Random(seed)
    w = [r.choice([0, 1, 1, 2.5, r.random() * 10]) for _ in range(r.randrange(1, 7))]
    caps = [r.choice([3, 50, 1000]) for _ in w]
    seats = r.choice([0, 1, 7, 100, 333])
    assert mixing.sainte_lague(w, seats, caps) == brute_sainte_lague(w, seats, caps)


def test_mix(spark):
    r = random.Random(0)
    docs = [(i, " ".join(r.choice(["ab", "cd", "ef"]) for _ in range(r.randrange(1, 30))) + f" {i}", r.choice([" Big", "big", "small ", None])) for i in range(600)]
    docs += [(700, docs[0][1], "big"), (701, None, "big"), (702, "", "big"), (703, "  ", "tiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("tokens", F.lit(1))
    targets = spark.createDataFrame([("p", "BIG ", 0.3, 1), ("p", "small", 0.7, 3), ("q", "small", 0.5, 2), ("q", "absent", 0.5, 2), ("z", "gone", 1.0, 1)], "plan string, source string, target_share double, max_repeats long")
    drawn = mixing.mix(df, targets)
    got = drawn.collect()
    assert all(x.copies <= {"big": 1, "small": 3}[x.source] for x in got if x.plan == "p")
    text = {i: t for i, t, _ in docs}
    for plan in "pq":
        used = Counter(text[x.doc_id] for x in got if x.plan == plan)
        assert max(used.values()) == 1  # a text is drawn through one document only
    share = {(x.plan, x.source): x for x in mixing.mix_report(drawn, targets).collect()}
    assert abs(share["p", "big"].actual_share - 0.3) < 0.01 and share["p", "small"].reached
    assert share["q", "absent"].actual_share == 0 and not share["q", "absent"].reached and share["q", "small"].actual_share == 1
    assert share["z", "gone"].tokens == 0
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, mixing.mix(df, targets, per_shard=10_000).collect()))
    fixed = mixing.mix_report(mixing.mix(df, targets, total_tokens=2000, per_shard=50), targets).collect()
    assert abs(sum(x.tokens for x in fixed if x.plan == "p") - 2000) < 250
    assert mixing.mix(df.limit(0), targets).count() == 0


# ---------------------------------------------------------------- shared spans


def brute_spans(docs, least):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - least + 1):
            where[t[i : i + least]].add(d)
    pairs = {(a, b) for s in where.values() for a in s for b in s if a < b}
    cover = {}
    for d, t in docs:
        hit = set()
        for i in range(len(t or "") - least + 1):
            if len(where[t[i : i + least]]) > 1:
                hit.update(range(i, i + least))
        if hit:
            cover[d] = len(hit)
    return pairs, cover


def quoting(seed, n=60):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice("abcdefgh éü信\n ") for _ in range(k))
    quotes = [word(k) for k in (30, 31, 45, 60, 200)]
    docs = [(i, "".join(word(r.randrange(0, 60)) + r.choice(quotes) * (r.random() < 0.6) for _ in range(r.randrange(1, 5)))) for i in range(n)]
    return docs + [(70, docs[0][1]), (71, docs[0][1]), (72, None), (73, ""), (74, "short"), (75, "x" * 300), (76, "y" + "x" * 250), (77, "z" * 500), (78, quotes[4][:40]), (79, quotes[4][10:40])]


@pytest.mark.parametrize("hot,chars,members", [(4096, 1 << 20, 1024), (3, 4000, 2), (1, 300, 3)])
def test_shared_spans_against_brute_force(spark, monkeypatch, hot, chars, members):
    monkeypatch.setattr(spans, "MEMBERS", members)
    docs = quoting(hot)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("pos", F.lit("extra"))
    found = spans.Shared(df, least=30, gram=8, hot_regions=hot, shard_chars=chars)
    pairs, cover = brute_spans(docs, 30)
    got = [tuple(x) for x in found.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    assert {x.doc_id: x.shared_chars for x in found.shares().collect()} == cover
    together = defaultdict(set)
    for g in found.groups().collect():
        together[g.g1, g.g2].add(g.doc_id)
    rep = {c.doc_id: c.rep for c in found.copies().collect()}
    of_groups = {(a, b) for s in together.values() for a in s for b in s if a < b}
    assert of_groups == {(min(rep[a], rep[b]), max(rep[a], rep[b])) for a, b in pairs if rep[a] != rep[b]}
    empty = spans.Shared(df.limit(0))
    assert empty.pairs().count() == 0 and empty.shares().count() == 0 and empty.groups().count() == 0


def test_shared_spans_of_a_hot_header_grow_with_the_documents(spark):
    r = random.Random(4)
    header = "".join(r.choice("abcdefghij ") for _ in range(260))
    rows = []
    for n in (400, 800):
        docs = [(i, header + chr(0x4E00 + i) + "".join(r.choice("klmnopqrst ") for _ in range(300))) for i in range(n)]
        found = spans.Shared(spark.createDataFrame(docs, "doc_id long, text string"), hot_regions=50)
        rows.append(found.found.count())
        assert {x.shared_chars for x in found.shares().collect()} == {260} and found.shares().count() == n
    assert rows[1] == 2 * rows[0]  # 61 spans a document, not a row for each pair
    docs = [(i, header + chr(0x4E00 + i) + "".join(r.choice("klmnopqrst ") for _ in range(300))) for i in range(120)]
    assert spans.Shared(spark.createDataFrame(docs, "doc_id long, text string"), hot_regions=50).pairs().count() == 120 * 119 // 2


def test_fingerprints_are_chosen_by_content():
    r = random.Random(3)
    for text in ["".join(r.choice("ab ") for _ in range(3000)), "x" * 900, "ab" * 400, "".join(r.choice("abc") * r.randrange(1, 90) for _ in range(60))]:
        h, p = spans.fingerprints(text, 40, 12)
        assert (np.diff(p) > 0).all() and all(((p >= j) & (p <= j + 28)).any() for j in range(len(text) - 39))
        cut = text[217:640]
        mine = set(spans.fingerprints(cut, 40, 12)[0].tolist())
        for j in range(0, len(cut) - 40, 7):  # both hold a fingerprint of every stretch, with the same hash
            inside = h[(p >= 217 + j) & (p <= 217 + j + 28)].tolist()
            assert mine & set(inside)
    assert len(spans.fingerprints("x" * 5000, 40, 12)[1]) < 200


def test_matching_statistics_against_brute_force():
    r = random.Random(8)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(12, 90))) for _ in range(12)]
    texts[5] = texts[1][3:40] + texts[2][:30]
    regions = [[k, 100 * k, t] for k, t in enumerate(texts)]
    for lane in (1, 7, 1024):
        members, found = spans.search_shard(regions, 12, lane)
        pairs, cover = brute_spans(list(enumerate(texts)), 12)
        groups = defaultdict(set)
        for g, d in members.tolist():
            groups[g].add(d)
        assert {(a, b) for s in groups.values() for a in s for b in s if a < b} == pairs
        got = defaultdict(set)
        for d, a, z in found.tolist():
            got[d].update(range(a - 100 * d, z - 100 * d))
        assert {d: len(v) for d, v in got.items()} == cover


def test_fm_index_counts():
    r = random.Random(9)
    text = np.array([r.randrange(1, 5) for _ in range(600)] + [0])
    for depth in (5, 12, 30):
        index = spans.FMIndex(text, depth, 4)
        for p in [[r.randrange(1, 5) for _ in range(5)] for _ in range(40)] + [text[k : k + 5].tolist() for k in range(560, 596)]:
            lo, hi = np.array([0]), np.array([len(text)])
            for c in reversed(p):
                lo, hi = index.extend(np.array([c]), lo, hi)
            assert sorted(index.places[lo[0] : hi[0]].tolist()) == [i for i in range(len(text) - 4) if (text[i : i + 5] == p).all()]
        gram = [tuple(text[i : i + depth]) for i in index.places]
        assert [a == b for a, b in zip(gram, gram[1:])] == [a == b for a, b in zip(index.group, index.group[1:])]
