"""Training-data operators against brute force, on small inputs with every odd case.

``ODD`` holds nulls in any column, empty, blank and long texts, ties and
repeated rows, an extra column and names that an operator might use itself.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections import Counter
import zipfile
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("crawlq.llm")

from crawlq.llm import components, decontaminate, mix, near_dup, quality, queries, suffix_dedup, tokens, topk, toxicity, url_lists, warc  # noqa: E402
from crawlq.llm.common import scratch_path, stored  # noqa: E402
from crawlq.llm.shingles import shingle_set  # noqa: E402
from crawlq.llm.suffix_sort import suffix_array  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, h long, doc string, copies long"
_WORDS = [f"w{i}" for i in range(400)]
LONG = " ".join(_WORDS[i % 400] + str(i // 7) for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(120))


def _row(i, text, source="a"):
    return (i, text, "en", source, None, 1, 0.5, 2, "x", 3)


ODD = [
    _row(1, LONG), _row(2, LONG), _row(2, LONG), _row(3, LONG + " tail one"), _row(4, None), _row(5, ""), _row(6, " \t\n"),
    _row(7, "one two three"), _row(8, "ONE two\nthree"), _row(None, "no id at all but six words"), _row(None, None, None),
    _row(9, "before " + PASSAGE + " after", None), _row(10, PASSAGE.upper() + " then", ""), _row(11, "a  b   c\n\n d <|endoftext|> é", "b"),
    _row(12, "x" * 5000, "b"), _row(12, "other text with this id", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- registered queries with SQL ---------------------------------------------

@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cols = ", ".join(got.columns)
    want = con.sql(f"select {cols} from ({queries.ORACLES[name]})").df()
    key = list(got.columns)
    a, b = (d.astype(object).where(d.notna(), None).astype(str).sort_values(key).reset_index(drop=True) for d in (got, want))
    for c in key:
        if got[c].dtype.kind in "if" or want[c].dtype.kind in "if":
            assert np.allclose(np.sort(got[c].astype(float)), np.sort(want[c].astype(float)), equal_nan=True), c
        elif c != "fetched":
            assert sorted(a[c]) == sorted(b[c]), c
    assert len(a) == len(b)


# ---- 1 WARC ---------------------------------------------------------------------

def test_warc_round_trip(spark):
    big = "é" * 60
    rows = [(3, "u3", big), (1, "u1", big), (2, None, big), (1, "u1", big), (4, "a\r\nb", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "n", big), (None, None, "z" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    d = hashlib.sha256(big.encode()).hexdigest()
    kinds = _sorted((r.page_id, r.record_type, r.refers_to) for r in got if r.payload_digest == d)
    assert kinds == _sorted([(1, "response", None)] * 2 + [(2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1)])
    assert {(r.page_id, r.payload_bytes, r.record_type) for r in got if r.page_id in (4, 5, 6, 7)} == {(4, 0, "response"), (5, 0, "response"), (6, 5, "response"), (7, 5, "response")}
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_warc_urls_come_back_as_they_were(spark):
    urls = ["http://a/%0D b", " http://a b ", None, "", "a\r\nb: c", "\u00a0x\x85", "http://é/?q=: 1", "line\n", "-"]
    rows = [(i, u, "x" * (i * 40), 5, "clash") for i, u in enumerate(urls)] + [(100, urls[4], "y" * 3_000_000, 1, "n"), (101, None, "y" * 3_000_000, 1, "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int, record_type string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert {i: r.url for i, r in got.items()} == {r[0]: r[1] for r in rows}
    assert (got[101].refers_to, got[101].payload_bytes) == (100, 3_000_000)


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directory(zip64):
    out = io.BytesIO()
    z = warc.ZipWriter(out, force_zip64=zip64)
    for name, data in (("a", b"hello"), ("é", b""), ("c", b"x" * 1000)):
        z.open(name)
        z.write(data)
        z.close_member()
    z.finish()
    with zipfile.ZipFile(out) as f:
        assert f.testzip() is None and f.read("a") == b"hello"
    where = warc.members(out, z.at)
    assert {k: out.getvalue()[a:a + n] for k, (a, n, _) in where.items()} == {"a": b"hello", "é": b"", "c": b"x" * 1000}
    std = io.BytesIO()
    with zipfile.ZipFile(std, "w") as f:
        f.comment = b"a comment"
        f.writestr("m", gzip.compress(b"data"))
    at, n, _ = warc.members(std, len(std.getvalue()))["m"]
    assert gzip.decompress(std.getvalue()[at:at + n]) == b"data"


def test_truncated_record_raises():
    raw = warc.record_bytes(1, "u", b"payload", None, "response")
    assert warc.parse_record(raw)[1] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw[:-6])


# ---- 2 top-k --------------------------------------------------------------------

def test_top_k_ties_nulls_and_lengths(spark):
    r = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in r.integers(-3, 4, 4) / 8]) for i in range(300)]
    rows += [(100, rows[100][1]), (1000, None), (1001, [1.0, None, 0.0, 0.0]), (1002, [float("nan")] * 4), (1050, [0.5, 0.5]), (1051, [1.0, 1.0]), (None, [1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = _sorted(topk.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect())
    good = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v and None not in v and not np.isnan(v).any()]
    want = []
    for qi, q in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        s = sorted((-int(np.dot(q, v)), i) for i, v in good if i != qi and len(v) == len(q))[:5]
        want += [(qi, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == _sorted(want)
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def _clusters(n, dim, seed):
    """Vectors around 16 far directions, dealt at random."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((16, dim)) * 4
    return centres[r.integers(0, 16, n)] + r.standard_normal((n, dim)) * 0.05


def test_top_k_in_rounds_over_many_shards(spark):
    m = _clusters(1500, 8, 5)
    m[700:1200] = m[700]                                # a third of the rows equal
    rows = [(i, [float(x) for x in v], "b", 1, 2, 3.5) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, slice string, shard int, rank int, v double").repartition(4)
    got = _sorted(topk.top_k(df, df.where("vec_id % 50 = 0"), shard_rows=40, block_rows=8).collect())
    x = np.floor(256 * m).astype(int)
    score = x[::50] @ x.T
    want = []
    for a, s in enumerate(score):
        best = sorted((-int(v), j) for j, v in enumerate(s) if j != 50 * a)[:5]
        want += [(50 * a, n + 1, j, -v) for n, (v, j) in enumerate(best)]
    assert got == _sorted(want)


def test_shards_move_only_where_a_bound_reaches_the_floor(spark):
    m = _clusters(4000, 16, 6)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, v array<double>")
    shards = topk._shards(topk._placed(df), 100)
    blocks = topk._blocks(topk._placed(df.where("id % 50 = 0")), 8)
    x = np.floor(256 * m)
    home = {int(i): r.shard for r in shards.collect() for i in np.frombuffer(r.ids, np.int64)}
    floors, needed = [], set()
    for b in blocks.collect():
        ids = np.frombuffer(b.q_ids, np.int64)
        best = [sorted((-int(s), j) for j, s in enumerate(x[i] @ x.T) if j != i)[:5] for i in ids]
        needed |= {(b.block, home[j]) for row in best for _, j in row}
        floors.append((b.block, np.array([-r[4][0] for r in best]).tobytes(), np.array([r[4][1] for r in best]).tobytes()))
    ready = topk._grouped(blocks, len(floors)).join(spark.createDataFrame(floors, topk._FLOORS), "block")
    n = shards.count()
    pairs = {(r.block, r.shard) for r in topk.live_pairs(ready, shards, len(floors), n).collect()}
    assert needed <= pairs
    assert len(pairs) < 0.4 * n * len(floors), (len(pairs), n, len(floors))


def test_ball_tree_prunes_nothing_it_needs(monkeypatch):
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    r = np.random.default_rng(2)
    m = r.integers(-50, 50, (500, 6)).astype(float)
    ids = r.permutation(500)
    tree = topk.build_tree(ids, m, leaf=8)
    q, q_ids = m[:20], ids[:20]
    s, i = topk.search(tree, q_ids, q, 5, np.full(20, topk._NONE), np.full(20, 1 << 60))
    for k in range(20):
        want = sorted((-int(q[k] @ m[j]), int(ids[j])) for j in range(500) if ids[j] != q_ids[k])[:5]
        assert [(-a, b) for a, b in zip(s[k].tolist(), i[k].tolist())] == want


# ---- 3 near duplicates -------------------------------------------------------------

def _components(rows):
    sets = [(i, {int(x) for x in shingle_set(t)}) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(sets):
        low.setdefault(find(k), []).append(i)
    return [(i, len(s), (min((j for j in low[find(k)] if j is not None), default=None) if s else i)) for k, (i, s) in enumerate(sets)]


def test_near_duplicates(spark, odd, none):
    got = near_dup.near_duplicates(odd).collect()
    assert _sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _sorted(_components([(r[0], r[1]) for r in ODD]))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_dup.near_duplicates(none).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = near_dup.near_duplicates(docs).collect()
    assert _sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == _sorted(_components([(r.doc_id, r.text) for r in docs.collect()]))


def test_near_duplicates_of_unlike_copies_and_a_common_passage(spark):
    r = np.random.default_rng(11)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(120):                     # edited in different places: some pairs are near, others just miss
        words = list(base)
        for k in r.choice(80, int(r.integers(1, 4)), replace=False):
            words[k] = f"e{i}x{k}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, PASSAGE + " " + " ".join(f"own{i}x{k}" for k in range(int(r.integers(5, 60))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_dup.near_duplicates(docs).collect()
    assert _sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _sorted(_components(rows))


def test_rows_of_one_id_do_not_meet_each_others_classes(spark, monkeypatch, tmp_path):
    log = tmp_path / "sets"

    def counted(text):
        with open(log, "a") as f:
            f.write(".")
        return shingle_set(text)

    monkeypatch.setattr(near_dup, "shingle_set", counted)
    rows = [(i, " ".join(f"t{k}x{j}" for j in range(60)) + end) for i in (None, 5) for k in range(15) for end in ("", f" end{i}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dup.near_duplicates(docs).collect()
    assert _sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == _sorted(_components(rows))
    assert len(log.read_text()) <= 2 * len(rows)      # once for the sketch, at most once for the full set


def test_bitmaps_never_differ_in_more_than_the_sets():
    r = np.random.default_rng(4)
    x = r.integers(0, 2 ** 63, 3000).astype(np.uint64)
    for n in (1, 10, 500, 2000):
        a, b = set(x[:n].tolist()), set(x[n // 3:n + n // 4].tolist())
        bits = np.bitwise_xor(near_dup.bitmap(x[:n]), near_dup.bitmap(x[n // 3:n + n // 4]))
        assert sum(bin(int(w)).count("1") for w in bits) <= len(a ^ b)


def test_one_of_each(spark, odd):
    left = near_dup.one_of_each(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 3 not in ids
    assert {4, 5, 6, 7, 9, 11} <= set(ids) and not {8, 10} & set(ids) and ids.count(12) == 2 and ids.count(None) == 2


def test_sketch_estimates_similarity():
    r = np.random.default_rng(3)
    x = r.integers(0, 2 ** 63, 1000).astype(np.uint64)
    a, b = near_dup.sketch(x[:800], 600), near_dup.sketch(x[200:], 600)
    assert abs((a == b).mean() - 0.6) < 0.08
    for n in (1, 2, 5):
        assert (near_dup.sketch(x[:n], 600) != near_dup._FULL).all()
    assert (near_dup.sketch(x[:50], 64) == near_dup.sketch(x[:50][::-1].copy(), 64)).all()


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


# ---- 4 decontamination ---------------------------------------------------------------

def test_contaminated(spark, odd, none):
    items = spark.createDataFrame([(1, PASSAGE), (2, "too short item"), (3, None), (4, "not in any document at all here"), (1, PASSAGE), (5, " ".join(["again"] * 9))],
                                  "item_id long, text string")
    got = _sorted((r.doc_id, r.item_id, round(r.similarity, 6), r.start) for r in decontaminate.contaminated(odd, items).collect())
    assert got == _sorted([(9, 1, 1.0, 1), (10, 1, 1.0, 0)])
    edited = PASSAGE.replace("p60 ", "changed ")
    more = spark.createDataFrame([(20, "x y z " + edited), (21, " ".join(PASSAGE.split()[:60])), (22, " ".join(["again"] * 30)), (23, "again " * 8)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(more, items).collect()}
    assert set(got) == {(20, 1), (22, 5), (23, 5)}
    assert abs(got[20, 1] - 111 / 121) < 1e-9 and got[22, 5] == 1.0 and abs(got[23, 5] - 0.8) < 1e-9
    assert decontaminate.contaminated(none, items).collect() == [] and decontaminate.contaminated(odd, items.limit(0)).collect() == []
    clean = decontaminate.clean_documents(odd, items)
    assert clean.columns == odd.columns and clean.count() == len(ODD) - 2


def test_clean_documents_judges_each_row_of_an_id(spark):
    items = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    rows = [_row(None, "x " + PASSAGE), _row(None, LONG), _row(None, None), _row(30, PASSAGE), _row(30, "a clean text under the same id"), _row(30, PASSAGE), _row(31, "")]
    clean = decontaminate.clean_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), items)
    assert _sorted((r.doc_id, r.text) for r in clean.collect()) == _sorted([(r[0], r[1]) for r in (rows[1], rows[2], rows[4], rows[6])])


def test_simhash_of_long_bags(spark):
    r = np.random.default_rng(6)
    for n in (3, 32_767, 32_768, 70_000):
        x = np.where(r.random(n) < 0.8, -1, r.integers(-2 ** 62, 2 ** 62, n))
        got = spark.createDataFrame([(x.tolist(),)], "bag array<long>").select(decontaminate._simhash("bag").alias("fp")).first().fp
        ones = [int(((x >> b) & 1).sum()) for b in range(64)]
        assert got & (2 ** 64 - 1) == sum(1 << b for b in range(64) if 2 * ones[b] > n), n


@pytest.mark.parametrize("slots", [1 << 20, 1])
def test_only_numbers_go_through_the_joins_of_shingles(spark, monkeypatch, slots):
    """Without broadcasts, and with a bitmap that rules out nothing, the result is the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = _sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect())
    joined, columns = [], {}
    monkeypatch.setattr(decontaminate, "maybe_broadcast", lambda df: joined.append(dict(df.dtypes)) or df)
    monkeypatch.setattr(decontaminate, "MAX_SLOTS", slots)
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: stored(columns.setdefault(name, df), name))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = _sorted(tuple(r) for r in decontaminate.contaminated(docs, items).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want and want
    assert not [t for sides in joined[:3] for t in sides.values() if "array" in t]
    for name in ("bench-places", "bench-places-of", "bench-blocks", "bench-near"):
        assert not [t for _, t in columns[name].dtypes if "array" in t], name


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_item_bags_stay_out_of_the_lookup_table(spark, monkeypatch, most):
    columns = {}

    def keep(df, name):
        columns[name] = dict(df.dtypes)
        return stored(df, name)

    monkeypatch.setattr(decontaminate, "stored", keep)
    monkeypatch.setattr(decontaminate, "BROADCAST_SHINGLES", most, raising=False)
    other = PASSAGE.replace("p", "q")
    items = spark.createDataFrame([(1, PASSAGE), (1, other), (None, PASSAGE), (2, " ".join(reversed(PASSAGE.split())))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b " + PASSAGE), (2, other), (3, None)], "doc_id long, text string")
    got = _sorted((r.doc_id, r.item_id, r.similarity, r.start) for r in decontaminate.contaminated(docs, items).collect())
    assert got == _sorted([(1, 1, 1.0, 2), (1, None, 1.0, 2), (2, 1, 1.0, 0)])
    assert not [t for t in columns["bench-blocks"].values() if "array" in t]


# ---- 5 and 9 classifiers ----------------------------------------------------------------

def test_quality_learns_and_handles_odd_texts(spark, odd, none):
    good = [(" ".join(f"word{i} and" for i in range(k, k + 30)) + ".\nAnother line here.", 1) for k in range(60)]
    bad = [(" ".join(f"W{i}!!" for i in range(k, k + 30)) + "\nBUY!! NOW!!", 0) for k in range(60)]
    model = quality.fit(good[:40] + bad[:40], steps=20)
    s = quality.score_texts(model, [t for t, _ in good[40:] + bad[40:]])
    assert s[:20].min() > s[20:].max() and s[:20].min() >= 0.7 > s[20:].max()
    rows = quality.score_quality(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(none, model).collect() == []
    kept = quality.score_quality(odd, model, keep=True).select("doc.*")
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert quality.score_texts(quality.fit([]), ["x", None]).tolist() == [0.5, 0.5]


def test_forward_backward_equals_enumeration():
    r = np.random.default_rng(0)
    scores, moves = r.normal(0, 1, 5), r.normal(0, 1, (2, 2))
    total, good = 0.0, np.zeros(5)
    for code in range(32):
        y = [(code >> k) & 1 for k in range(5)]
        w = np.exp(sum(s for s, v in zip(scores, y) if v) + sum(moves[a, b] for a, b in zip(y, y[1:])))
        total += w
        good += w * np.array(y)
    got = quality.forward_backward(np.concatenate([scores, scores[:2]]), np.array([5, 2]), moves)
    assert np.allclose(got[:5], good / total)


def test_toxicity_gradients_and_windows(spark, odd, none):
    net = toxicity.new_net(3)
    p = {k: v.astype(float) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    g, mask, w = r.normal(0, 1, (6, 3, 2, 24)), (r.random((6, 3)) < 0.8).astype(float), r.normal(0, 1, 3)
    _, saved = toxicity.forward(p, g, mask, keep=True)
    d, _ = toxicity.backward(p, g, mask, w, saved)
    for k in ("U", "A", "v", "o", "c"):
        i = tuple(int(r.integers(0, x)) for x in p[k].shape)
        p[k][i] += 1e-3
        up = toxicity.forward(p, g, mask) @ w
        p[k][i] -= 2e-3
        down = toxicity.forward(p, g, mask) @ w
        p[k][i] += 1e-3
        assert abs((up - down) / 2e-3 - d[k][i]) < 1e-4
    for n in (0, 1, 24, 25, 40, 41, 100):
        st = toxicity.window_starts(n)
        assert len(st) and (n <= 24 or set(range(n)) == {x for s in st for x in range(s, min(n, s + 24))})
    rows = toxicity.score_toxicity(odd, net).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows) and toxicity.score_toxicity(none, net).collect() == []


def test_toxicity_learns():
    r = np.random.default_rng(5)
    plain = [" ".join(f"tok{r.integers(0, 200)}" for _ in range(60)) for _ in range(800)]
    nasty = [" ".join([*t.split()[:30], "vilename", *t.split()[30:]]) for t in plain[:400]]
    net = toxicity.fit([(t, 1) for t in nasty[:300]] + [(t, 0) for t in plain[400:700]])
    s = toxicity.Scorer(net).scores(nasty[300:] + plain[700:])
    assert (s[:100, None] > s[None, 100:]).mean() > 0.95


# ---- 6 URL lists ---------------------------------------------------------------------------

def test_url_lists(spark):
    e = spark.createDataFrame([
        ("spam", "bad.com", "2024-01-10", "add"), ("spam", "bad.com", "2024-02-10", "remove"), ("spam", "bad.com", "2024-06-01", "add"),
        ("allow", "x.bad.com/ok", "2024-01-01", "add"), (None, "bad.com", "2024-01-01", "add"), ("spam", None, "2024-01-01", "add"), ("spam", "day.com", "2024-03-01", "add"), ("spam", "day.com", "2024-03-01", "remove")],
        "list string, pattern string, at string, action string")
    c = spark.createDataFrame([
        (1, "http://x.bad.com/a", "2024-01-09"), (2, "http://x.bad.com/a", "2024-01-10"), (3, "HTTPS://u@X.BAD.com.:8080/ok/b?q#f", "2024-01-20"), (4, "http://bad.com", "2024-02-10"),
        (5, "http://bad.com", "2025-01-01"), (6, None, "2024-01-20"), (7, "no url", "2024-01-20"), (8, "http://bad.com", None), (9, "http://notbad.com/", "2024-01-20"),
        (10, "http://day.com", "2024-03-02"), (2, "http://x.bad.com/a", "2024-01-10")], "page_id long, url string, fetched string")
    got = _sorted((r.page_id, r.verdict) for r in url_lists.judge(c, e).collect())
    assert got == _sorted([(1, "unlisted"), (2, "blocked"), (2, "blocked"), (3, "allowed"), (4, "unlisted"), (5, "blocked"), (6, "unlisted"), (7, "unlisted"), (8, "unlisted"), (9, "unlisted"), (10, "unlisted")])
    assert url_lists.judge(c.limit(0), e).collect() == []


def test_url_lists_of_very_long_urls_and_clashing_names(spark):
    e = spark.createDataFrame([("spam", "bad.com", "2024-01-01", "add", 1), ("allow", "x.bad.com/a/a/a", "2024-01-01", "add", 2), ("spam", "one", "2024-01-01", "add", 3)],
                              "list string, pattern string, at string, action string, key int")
    deep, wide = "a/" * 500_000, "w." * 100_000
    c = spark.createDataFrame([
        (1, "http://x.bad.com/" + deep, "2024-02-01"), (2, "http://x.bad.com//a///a", "2024-02-01"), (3, f"http://{wide}bad.com/x", "2024-02-01"),
        (4, "http://x.bad.com/" + "/" * 1_000_000 + "a/a/a/", "2024-02-01"), (5, "http://ok.com/" + "b" * 1_000_000, "2024-02-01"), (6, "http://one", "2024-02-01")],
        "page_id long, url string, fetched string").selectExpr("*", "'x' AS list", "1 AS pattern", "2 AS period")
    got = {r.page_id: (r.verdict, r.pattern) for r in url_lists.judge(c, e).collect()}
    assert got == {1: ("allowed", "x.bad.com/a/a/a"), 2: ("blocked", "bad.com"), 3: ("blocked", "bad.com"), 4: ("allowed", "x.bad.com/a/a/a"),
                   5: ("unlisted", None), 6: ("blocked", "one")}


# ---- 7 mixing ---------------------------------------------------------------------------------

def test_mix(spark, odd, none):
    got = mix.mix_documents(odd).collect()
    assert len(got) == len(ODD) and _sorted(got) == _sorted(mix.mix_documents(odd.repartition(5)).collect())
    assert all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    kept = mix.mix_documents(odd, keep=True)
    assert kept.columns == odd.columns and kept.count() == sum(r.copies for r in got)
    assert mix.mix_documents(none).collect() == []


def test_mix_hits_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    got = mix.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=(1, 1)).collect()
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert all(abs(sum(t) - k[1]) <= 7 for k, t in by.items())


@pytest.mark.parametrize("seed", ["mix-1", "s2", "s3", "s4"])
def test_mix_hits_the_target_inside_a_group_of_equal_rows(spark, seed):
    rows = [(i, f"{i} " + "w " * 149, "a") for i in range(2000)] + [(-1, "z " * 100, "a")] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix.mix_documents(docs, share=(9, 16), seed=seed).collect()
    assert len(got) == 3000 and got[0].target == 225_000
    assert abs(sum(r.taken for r in got) - 225_000) <= 75
    again = mix.mix_documents(docs.repartition(3), share=(9, 16), seed=seed)
    assert _sorted(tuple(r) for r in got) == _sorted(tuple(r) for r in again.collect())
    assert mix.mix_documents(docs, share=(9, 16), seed=seed, keep=True).count() == sum(r.copies for r in got)


def test_mix_of_nothing_but_one_repeated_row(spark):
    docs = spark.createDataFrame([(1, "a b c d", None)] * 101, "doc_id long, text string, source string")
    got = mix.mix_documents(docs, share=(1, 2)).collect()
    assert sum(r.taken for r in got) in (200, 204) and len(got) == 101


# ---- 8 token ids ---------------------------------------------------------------------------------

def test_token_files(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok = Tokenizer.from_file(path)
    out = scratch_path(spark, "tokens")
    tokens.write_tokens(odd, out, path)
    got = sorted(tokens.token_digest(tokens.read_tokens(spark, out)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got if r.doc_id is not None] == sorted(r[0] for r in ODD if r[0] is not None)
    want = {}
    for r in ODD:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4")
        want.setdefault(r[0], []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    empty = scratch_path(spark, "tokens")
    tokens.write_tokens(none, empty, path)
    assert tokens.token_digest(tokens.read_tokens(spark, empty)).collect() == []


@pytest.mark.parametrize("text", ["", " ", "  ", "a, b. c", "x), y", "1, 2. 3", "it's, he'll. ok", "a\n\n b", "　 x  y", "tab\t x", "\0 nul, x. y", "<|endoftext|>, z. <|endoftext|>", "é, ñ. ß", "a!! b%%% c\u00d7. d\u0142; \u00a0 x", "x<|endoftext|>y! z"])
def test_pieces_encode_like_the_text(text):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [0]
    ids, counts = tokens.encode([b"", text.encode(), b"  "], path)
    assert ids[1:1 + counts[1]].tolist() == want and counts[0] == 1


def test_pieces_of_whole_texts_with_a_full_cache(monkeypatch):
    import duckdb as db
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = [t or "" for (t,) in db.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()]
    tok = Tokenizer.from_file(path)
    want = [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    monkeypatch.setattr(tokens, "CACHE_PIECES", 500)
    tokens._WORKERS.clear()
    got = []
    for k in range(0, len(texts), 7):
        ids, counts = tokens.encode([t.encode() for t in texts[k:k + 7]], path)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    tokens._WORKERS.clear()
    assert got == want


@pytest.mark.parametrize("task", ["near_dup", "quality"])
def test_tasks_of_other_operators_drop_the_cached_pieces(spark, task):
    class Rows:                               # hands out the function that tasks run
        columns = ["doc_id", "text"]

        def select(self, *cols):
            return self

        def mapInArrow(self, run, schema):
            return run

    tokens.encode([b"words kept, by the worker"], queries.tokenizer_path())
    assert tokens._WORKERS
    run = near_dup._base(Rows()) if task == "near_dup" else quality.score_quality(Rows(), None)
    assert list(run(iter([]))) == [] and not tokens._WORKERS


# ---- 10 repeated strings ----------------------------------------------------------------------------

def test_suffix_array_equals_sorting():
    r = np.random.default_rng(0)
    for t in range(150):
        k = int(r.integers(2, 5))
        s = np.concatenate([r.integers(1, k, int(r.integers(1, 60))), [0]]).astype(np.int32)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffix_array(s, k, limit=64 if t % 2 else 1 << 20).tolist() == want


def _brute(texts):
    raw = [(t or "").encode() for t in texts]
    n = {}
    for b in raw:
        for i in range(len(b) - 399):
            n[b[i:i + 400]] = n.get(b[i:i + 400], 0) + 1
    out = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - 399):
            if n[b[i:i + 400]] > 1:
                m[i:i + 400] = True
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((len(b), int(m.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 1])
def test_remove_repeats(spark, odd, none, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = suffix_dedup.remove_repeats(odd).collect()
    want = [(r[0], *x) for r, x in zip(ODD, _brute([r[1] for r in ODD]))]
    assert _sorted(got) == _sorted(want)
    assert suffix_dedup.remove_repeats(none).collect() == []


# ---- pipeline ------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, odd):
    cp = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "token_ids"]
    for name, stage in cp.STAGES[1:4]:
        assert stage(spark, odd, SF).columns == odd.columns, name
    rows = cp.run(spark, SF)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 0


def test_pipeline_deletes_its_scratch_tables(spark, monkeypatch, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr("crawlq.llm.common.shared_root", lambda spark: str(tmp_path))

    def stage(spark, docs, sf_dir):
        return stored(stored(docs, "own").where("doc_id % 7 <> 0"), "own")

    def failing(spark, docs, sf_dir):
        stored(docs, "own")
        raise RuntimeError("stage")

    monkeypatch.setattr(cp, "STAGES", [("a", stage), ("b", stage), ("c", stage), ("last", lambda spark, docs, sf_dir: docs)])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert cp.run(spark, SF).count() == docs.where("doc_id % 7 <> 0").count()
    assert [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["pipeline", "c"]]
    monkeypatch.setattr(cp, "STAGES", [("a", failing), ("last", stage)])
    with pytest.raises(RuntimeError, match="stage"):
        cp.run(spark, SF)
    assert not [p for p in tmp_path.iterdir() if p.name.startswith("own")]


def _best_windows(rows, items):
    """(doc_id, item_id) -> (similarity, -start, words) of the best window, by trying every window; and the dirty rows."""
    def bag(words):
        return Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))

    bags = [(i, len((t or "").lower().split()), bag((t or "").lower().split())) for i, t in items]
    best, dirty = {}, set()
    for k, (i, t) in enumerate(rows):
        words = (t or "").lower().split()
        whole = set(bag(words))
        for item, w, b in bags:
            if not b or not whole & set(b):       # similarity 0 everywhere
                continue
            for start in range(max(1, len(words) - w + 1)):
                x = bag(words[start:start + w])
                both, union = sum((x & b).values()), sum((x | b).values())
                if 100 * both >= 75 * union:
                    dirty.add(k)
                    best[i, item] = max(best.get((i, item), (0, 0, 0)), (both / union, -start, w))
    return best, dirty


def test_contaminated_equals_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = decontaminate.contaminated(docs, items).collect()
    want, _ = _best_windows([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert {(r.doc_id, r.item_id): (r.similarity, -r.start, r.words) for r in got} == want and len(got) == len(want)


def test_remove_repeats_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, _brute([r.text for r in rows]))]
    assert _sorted(suffix_dedup.remove_repeats(docs).collect()) == _sorted(want)


def test_pipeline_equals_plain_stages(spark):
    from tokenizers import Tokenizer

    cp = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = docs.toPandas()
    rows = rows[quality.score_texts(model, rows.text.tolist()) >= quality.THRESHOLD]
    found = _components(list(zip(rows.doc_id, rows.text)))
    rows = rows[[i == c for i, _, c in found]]            # ids are unique here
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    _, dirty = _best_windows(list(zip(rows.doc_id, rows.text)), items)
    rows = rows[[k not in dirty for k in range(len(rows))]]
    con = duckdb.connect()
    con.register("documents", rows)
    copies = dict(con.sql(f"select doc_id, copies from ({mix.ORACLE})").fetchall())
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in zip(rows.doc_id, rows.text):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, len(ids), zlib.crc32(ids.tobytes()))] * copies[i]
    got = sorted(cp.run(spark, SF).collect(), key=lambda r: r.start)
    assert _sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == _sorted(want)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
