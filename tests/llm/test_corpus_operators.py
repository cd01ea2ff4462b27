"""Operators that need all rows, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_text_operators import ODD, empty_documents, odd_documents

import corpus_pipeline
from twinspan.llm import jaccard_join, mixing, neighbours, packing, quality_classifier, toxicity, warc_fixity
from twinspan.llm.words import word_count, words
from twinspan.plans.scratch import save
from twinspan.sources.tables import table

DATA = "/root/testdata/sf0.001"


def lowered(word: bytes) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in word)


def shingles(text, k):
    w = [lowered(x) for x in words(text)]
    n = min(k, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute_components(texts: dict, k, num, den):
    sets = {d: shingles(t, k) for d, t in texts.items()}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    for a, b in {(a, b) for ds in having.values() for a in ds for b in ds if a < b}:
        both = len(sets[a] & sets[b])
        if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_corpus():
    """Groups of near copies of several kinds: chains, a star, a common passage, short texts, exact copies."""
    rng = random.Random(11)
    prose = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    texts = [*ODD, *(" ".join(prose(rng.randint(1, 12))) for _ in range(20))]
    passage = prose(60)
    texts += [" ".join(prose(40) + passage + prose(40)) for _ in range(30)]
    base = prose(200)
    for _ in range(40):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = f"x{rng.randint(0, 10**6)}"
        texts.append(" ".join(near))
    chain = prose(150)
    for i in range(12):
        chain[10 * i] = f"y{i}"
        texts.append(" ".join(chain))
    texts += [texts[-1].upper(), texts[-1], texts[40], texts[40]]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return {d: texts[i] for d, i in enumerate(order)}


@pytest.mark.parametrize(("k", "similarity", "stars"), [(3, (9, 10), 1), (5, (4, 5), 2), (3, (9, 10), 0)])
def test_jaccard_join_by_brute_force(spark, k, similarity, stars):
    texts = near_corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, k, similarity, stars).collect()}
    want = brute_components(texts, k, *similarity)
    assert found == want and len({c for _, c in want.values()}) < len(texts) - 30


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 11, 19, 20, 21, 57, 500])
@pytest.mark.parametrize("similarity", [(9, 10), (4, 5)])
def test_prefixes_of_similar_sets_meet(n, similarity):
    rng = np.random.default_rng(n)
    num, den = similarity
    for _ in range(30):
        a = rng.integers(1, 2**63, n, np.uint64)
        gone = int(rng.integers(0, n - -(-n * num // den) + 1))
        b = np.unique(np.concatenate((a[gone:], rng.integers(1, 2**63, int(rng.integers(0, n // 8 + 1)), np.uint64))))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if not len(b) or den * both < num * (len(a) + len(b) - both):
            continue
        need = min(jaccard_join.common(len(a), similarity), jaccard_join.common(len(b), similarity))
        for o in range(3):
            assert len(np.intersect1d(jaccard_join.prefix(a, similarity, o), jaccard_join.prefix(b, similarity, o))) >= need
        assert jaccard_join.similar([a], [b], np.ones((1, 1), bool), similarity).all()


@pytest.mark.parametrize("stars", [0, 1])
def test_jaccard_join_in_small_blocks_and_with_shuffled_ids(spark, monkeypatch, stars):
    """Blocks of few nodes, no table of ids sent, and an id of two texts of one size, each near another document."""
    for name, value in (("BLOCK_NODES", 4), ("SENT", 0)):
        monkeypatch.setattr(jaccard_join, name, value)
    texts = near_corpus()
    rng = random.Random(2)
    one, two = ([f"v{rng.randint(0, 10**6)}" for _ in range(100)] for _ in range(2))
    rows = [*texts.items(), (1005, " ".join(one)), (1005, " ".join(two)), (1001, " ".join([*one[:-1], "x"])), (1002, " ".join([*two[:-1], "y"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, 3, (9, 10), stars).collect()}
    assert found == {d: c for d, (_, c) in brute_components(texts, 3, 9, 10).items()} | {1001: 1001, 1002: 1001, 1005: 1001}


def family(rng, g: int, words: int, changed: int) -> dict[int, str]:
    """`g` texts, each with other words in place of so many of one text's, next to each other."""
    base = [f"w{i}" for i in range(words)]
    texts = {}
    for d in range(g):
        at = rng.randrange(words - changed)
        texts[d] = " ".join(base[:at] + [f"x{rng.randint(0, 10**9)}" for _ in range(changed)] + base[at + changed :])
    return texts


def test_jaccard_join_moves_few_sets_of_a_family(spark, monkeypatch):
    """Texts alike but not similar are all compared; before, each block of their sets travelled once for each other block."""
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 4)
    texts = family(random.Random(3), 120, 300, 12)
    texts |= {1000 + d: f"{text} end" for d, text in list(texts.items())[:9]}
    moved = []
    sets_in = {"s": F.lit(1), "a": F.size("a"), "b": F.coalesce(F.size("b"), F.lit(0))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    usual = type(docs).mapInArrow

    def spied(self, func, schema, *args):
        if found := [sets_in[c] for c in self.columns if c in sets_in]:
            moved.append(self.agg(F.sum(sum(found[1:], found[0]))).first()[0] or 0)
        return usual(self, func, schema, *args)

    monkeypatch.setattr(type(docs), "mapInArrow", spied)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs).collect()}
    assert found == brute_components(texts, 3, 9, 10)
    assert len(texts) <= sum(moved) < 6 * len(texts)


@pytest.mark.parametrize("stars", [0, 1])
def test_jaccard_join_keeps_few_links_of_near_copies(spark, monkeypatch, stars):
    """All of 60 texts are similar to each other; before, all pairs of a block came out as links."""
    texts = family(random.Random(4), 60, 300, 2)
    counts, usual = [], jaccard_join.save

    def counted(df, name):
        out = usual(df, name)
        if name == "links":
            counts.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "save", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs, 3, (9, 10), stars).collect()}
    assert set(found.values()) == {0} and len(found) == 60
    assert sum(counts) < 2 * len(texts)


def test_jaccard_join_deals_every_pair_once(spark, monkeypatch):
    """Nodes of different components of a cell lie in one group or pass by it, once."""
    for name, value in (("BLOCK_NODES", 4), ("HELD", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = [(i, 50, i, 7 if i < 80 else i, 1 if i < 120 else 2) for i in range(150)]
    state = spark.createDataFrame(rows, "node long, n long, low long, component long, cell long")
    at = {}
    for r in jaccard_join._dealt(state).collect():
        at.setdefault(r.group, []).append((r.node, r.passing))
    met = [tuple(sorted((a, b))) for x in at.values() for a, by in x if not by for b, passing in x if passing or a < b]
    component = {r[0]: (r[4], r[3]) for r in rows}
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if component[a][0] == component[b][0] and component[a] != component[b]}
    assert len(met) == len(set(met)) and want <= set(met)
    assert max(sum(not passing for _, passing in x) for x in at.values()) < 40


def test_jaccard_join_on_odd_rows(spark):
    rows = jaccard_join.near_duplicates(odd_documents(spark)).collect()
    assert len(rows) == odd_documents(spark).count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].n_shingles == 0 and by_id[0].component_id == 0 and by_id[1].component_id == 1
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard_join.near_duplicates(empty_documents(spark)).count() == 0
    kept = jaccard_join.keep_one(odd_documents(spark), 5, (4, 5))
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and kept.columns == odd_documents(spark).columns
    assert jaccard_join.keep_one(empty_documents(spark), 5, (4, 5)).count() == 0


def test_neighbours_by_brute_force(spark):
    path = "/root/testdata/sf0.1"
    rows = table(spark, path, "embeddings").orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    found = defaultdict(dict)
    for r in neighbours.query(spark, path).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (vectors * vectors[q]).sum(1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        got = found[ids[q]]
        assert sorted(got) == list(range(1, 21)) and all(s == score[np.flatnonzero(ids == v)[0]] for v, s in got.values())
        assert [got[i] for i in range(1, 21)] == sorted(got.values(), key=lambda x: (-x[1], x[0]))
        hits += len({v for v, _ in got.values()} & set(ids[order].tolist()))
        total += 20
    assert hits >= 0.9 * total


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
def test_neighbours_of_mixed_lengths(spread):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(4096, 64))
    v *= np.exp(spread * rng.normal(size=(4096, 1))) / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for i, (found, _) in enumerate(neighbours.Block(np.arange(4096), v, neighbours.pivots(v)).search(np.arange(60), v[:60])):
        best = [j for j in np.argsort(-(v @ v[i])).tolist() if j != i][:20]
        hits += len({*best} & {*found.tolist()})
    assert hits >= 0.9 * 60 * 20


def test_neighbours_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (20, [-1.0, 0.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, rank int, block string")
    found = neighbours.nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found if r.query_id == 0] == [(0, 1, 1), (0, 2, 2), (0, 3, 20)]
    assert [r.vec_id for r in found if r.query_id == 20] == [1, 2, 0, 0]
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_targets(sizes: dict, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if most * sizes[s] <= weight[s] * level}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


def test_mixing(spark):
    rows = mixing.query(spark, "/root/testdata/sf0.01")
    source = {r.doc_id: (r.source, len(words(r.text))) for r in table(spark, "/root/testdata/sf0.01", "documents").collect()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    once = rows.collect()
    for r in once:
        s, n = source[r.doc_id]
        assert r.size == n and r.taken % max(n, 1) == 0 and r.taken <= 2 * n
        sizes[s] += n
        taken[s] += r.taken
        target[s] = r.target
    want = brute_targets(sizes)
    assert target == pytest.approx(want) and sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert all(abs(taken[s] - want[s]) <= max(n for x, n in source.values() if x == s) for s in want)
    assert sorted(map(tuple, mixing.query(spark, "/root/testdata/sf0.01").collect())) == sorted(map(tuple, once))


def test_mixed_rows_are_what_mix_says(spark):
    docs = table(spark, DATA, "documents")
    times = {r.doc_id: r.taken // r.size for r in mixing.mix(docs, word_count(F.col("text"))).collect()}
    found = defaultdict(int)
    for r in mixing.mixed(docs, word_count(F.col("text"))).collect():
        found[r.doc_id] += 1
    assert found == {d: n for d, n in times.items() if n}


def test_rows_without_ids_meet_their_target(spark):
    rows = [(None if i % 3 else 7, " ".join(["w"] * (1 + i % 9)) + f" {i}", s) for i in range(600) for s in ("a", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = mixing.mix(docs, word_count(F.col("text"))).groupBy("target").agg(F.sum("taken").alias("n")).collect()
    assert len(taken) == 2 and all(abs(r.n - r.target) <= 10 for r in taken)


def test_mixing_odd_rows(spark):
    size = word_count(F.col("text"))
    rows = mixing.mix(odd_documents(spark), size).collect()
    assert len(rows) == odd_documents(spark).count() and all(r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(empty_documents(spark), size).count() == mixing.mixed(empty_documents(spark), size).count() == 0
    nothing = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(nothing, size).collect()} == {(0, 0.0, 0)}


def test_warc_round_trip(spark, tmp_path):
    pages = table(spark, DATA, "pages")
    rows = warc_fixity.records(pages).orderBy("page_id").collect()
    data = b"".join(bytes(r.record) for r in rows)
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(bytes(r.record)) for r in rows))
    found = warc_fixity.read_warc(spark, str(tmp_path / "*.warc*")).collect()
    want = [(r.url, (r.html or "").encode()) for r in pages.orderBy("page_id").collect()]
    for name in ("a.warc", "b.warc.gz"):
        mine = sorted((r for r in found if r.file.endswith(name)), key=lambda r: r.number)
        assert [(r.uri, bytes(r.body)) for r in mine] == want
        assert all(data[r.offset : r.offset + 5] == b"WARC/" for r in mine) and sum(r.length for r in mine) == len(data)


def test_warc_audit_by_brute_force(spark):
    rng = random.Random(6)
    ours = [(f, i, 100 * i, 100 * i + 100, f"{f}-{i}") for f, n in ((0, 1), (1, 300), (2, 17), (3, 16)) for i in range(n)]
    theirs = [r for r in ours if r[:2] != (1, 299)] + [(4, 0, 0, 9, "new")]
    theirs = [(*r[:4], "bad") if rng.random() < 0.05 else r for r in theirs]
    frame = lambda rows: spark.createDataFrame(rows, "file long, number long, offset long, end long, hash string")
    found = {(r.file, r.number, r.hash, r.other_hash) for r in warc_fixity.audit(frame(ours), frame(theirs)).collect()}
    a, b = ({r[:2]: r[4] for r in x} for x in (ours, theirs))
    assert found == {(*k, a.get(k), b.get(k)) for k in a | b if a.get(k) != b.get(k)}
    assert warc_fixity.audit(frame(ours), frame(ours)).count() == 0
    assert warc_fixity.audit(frame([]), frame([])).count() == 0


def test_warc_files_are_audited_whole(spark, tmp_path):
    one = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://a\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    other = one.replace(b"Content-Length: 5", b"content-length:5").replace(b"hello", b"olleh")
    broken = one.replace(b"Content-Length: 5", b"Content-Length: x")
    data = one + broken + other + b"junk" + b"\r\n" + one + b"WARC/1.0\r\ncut"
    found = [(at, n, bool(h), body) for at, n, h, body in warc_fixity.parse(data)]
    assert b"".join(data[at : at + n] for at, n, _, _ in found) == data
    assert [x[3] for x in found if x[2]] == [b"hello", b"olleh", b"hello"] and [x[3] for x in found if not x[2]] == [broken, b"junk\r\n", b"WARC/1.0\r\ncut"]
    read = lambda name: warc_fixity.leaves(warc_fixity.read_warc(spark, str(tmp_path / name))).withColumn("file", F.lit("x"))
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc").write_bytes(data.replace(b"junk", b"jusk"))
    (tmp_path / "c.warc").write_bytes(data.replace(b"http://a", b"http://b", 1))
    (tmp_path / "d.warc").write_bytes(data[: len(data) - 13])
    (tmp_path / "e.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(broken)[:-3] + gzip.compress(other))
    a = read("a.warc")
    numbers = lambda x: sorted(r.number for r in warc_fixity.audit(a, read(x)).collect())
    assert [numbers(x) for x in ("a.warc", "b.warc", "c.warc", "d.warc")] == [[], [3], [0], [5]]
    assert [bytes(r.body) for r in warc_fixity.read_warc(spark, str(tmp_path / "e.warc.gz")).collect() if r.uri] == [b"hello", b"olleh"]
    moved = a.withColumn("end", F.when(F.col("number") == 2, F.col("end") + 1).otherwise(F.col("end")))
    assert [r.number for r in warc_fixity.audit(a, moved).collect()] == [2]


def test_warc_query(spark):
    path = "/root/testdata/sf0.01"
    pages = table(spark, path, "pages")
    hit = pages.where(F.pmod(F.xxhash64(F.lit(3), "page_id"), F.lit(97)) == 0)
    digests = {r.page_id: hashlib.sha256(bytes(r.record)).hexdigest() for r in warc_fixity.records(pages).collect()}
    found = warc_fixity.query(spark, path).collect()
    assert {r.page_id for r in found} == {r.page_id for r in hit.collect()} and len(found) == hit.count() > 0
    assert all(r.hash == digests[r.page_id] != r.other_hash for r in found)
    odd = spark.createDataFrame([(None, None, None), (1, "u", None), (1, "u", None)], "page_id long, url string, html string")
    narrow = warc_fixity.records(odd.union(pages.select(odd.columns))).select("page_id", F.length("record").cast("long").alias("length"), F.lit(7).alias("file"))
    laid = warc_fixity.laid_out(narrow, ["page_id"], 1 << 16).collect()
    assert len(laid) == narrow.count() and len({(r.file, r.number) for r in laid}) == len(laid) and len({r.file for r in laid}) > 1
    ends = {(r.file, r.number): r.offset + r.length for r in laid}
    assert all(r.offset == ends.get((r.file, r.number - 1), 0) for r in laid)
    assert sorted(laid, key=str) == sorted(warc_fixity.laid_out(narrow.repartition(7), ["page_id"], 1 << 16).collect(), key=str)
    assert warc_fixity.laid_out(narrow.limit(0), ["page_id"]).count() == 0


def test_pipeline_stages(spark):
    path = DATA
    docs = table(spark, path, "documents")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "toxicity", "jaccard_join", "mixing", "packing"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = save(stage(spark, before, path), name)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.collect()}
        assert after <= ids
        if name == "quality_classifier":
            scores = {r.doc_id: r.predicted for r in quality_classifier.quality_scores(before, table(spark, path, "labels")).collect()}
            assert after == {d for d in ids if scores[d]}
        if name == "toxicity":
            assert after == {r.doc_id for r in toxicity.toxicity(before, table(spark, path, "labels")).collect() if not r.toxic}
        if name == "jaccard_join":
            groups = brute_components({d: texts[d] for d in ids}, 5, 4, 5)
            assert after == {d for d, (_, c) in groups.items() if c == d}
        ids = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path)
    assert {r.doc_id for r in packed.collect()} == ids and "sequence_id" in packed.columns
    assert packing.pack_documents(docs).count() == packed.count()


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated texts, further columns: what has an id comes out at most twice, all pieces whole."""
    odd_documents(spark).union(table(spark, DATA, "documents").limit(60).select("doc_id", "text", "lang", "source", F.lit("x"), F.lit(1), F.lit(2))).write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, DATA, "labels").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and all(r.length <= 2048 and r.offset + r.length <= 2048 for r in rows)
    odd_documents(spark).limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    table(spark, DATA, "labels").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
