import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup, line_dedup, near_dedup
from strandloom.llm.common import Words, components

from .corpus import LOWER, empty, frame, rows, words_of


def sets(data):
    out = {}
    for i, text, *_ in data:
        w = words_of((text or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute_components(sets_):
    parent = {i: i for i in sets_}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets_)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets_[a] & sets_[b])
            if common and 100 * common >= 75 * (len(sets_[a]) + len(sets_[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets_}


def short_digest():
    """Digests that clash: one byte. A closure, as workers cannot import this module."""
    return lambda data: hashlib.sha256(data).digest()[:1]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("digest", [exact_dedup._sha256, short_digest()], ids=["whole", "clashing"])
def test_exact_groups_match_brute_force(spark, keep, digest):
    data = rows()
    ids = defaultdict(list)
    for i, text, *_ in data:
        ids[text or ""].append(i)
    got = exact_dedup.groups(frame(spark), keep, digest=digest).collect()
    wanted = Counter()
    for i, text, *_ in data:
        named = [x for x in ids[text or ""] if x is not None]
        best = (min if keep == "smallest" else max)(named) if named else None
        wanted[i, best, len(ids[text or ""]), i == best, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == wanted
    assert max(wanted.values()) > 1
    more = exact_dedup.groups(frame(spark), keep, digest=digest, memtable=3, fan_in=2, most_filter_bits=64).collect()
    assert Counter(tuple(r) for r in more) == wanted


def test_index_takes_lots_and_compacts_by_level(spark):
    data = [(f"k{i:03}", f"text {i % 70}") for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id string, text string")
    index = exact_dedup.MergeIndex(spark, "string", memtable=4, fan_in=3)
    for lot in range(3):
        index.insert(docs.where(F.col("doc_id").substr(2, 3).cast("int") % 3 == lot).repartition(2))
    got = {(r["smallest"], r["largest"], r["n"]) for r in index.hits().collect()}
    assert got == {(f"k{i:03}", f"k{i + 70:03}", 2) for i in range(30)}
    assert len(index.levels) > 2 and not index.levels[0]
    for level, paths in enumerate(index.levels):
        assert not paths or index.runs(level).select("lot", "run").distinct().count() <= 3
    index.insert(spark.createDataFrame([("a", "text 69"), ("z", "new")], "doc_id string, text string"))
    assert ("a", "k069", 2) in {(r["smallest"], r["largest"], r["n"]) for r in index.hits().collect()}


def test_filters_hold_what_was_added_and_little_else():
    keys = [hashlib.sha256(bytes([k % 256, k // 256])).digest() for k in range(6000)]
    one = exact_dedup.Filter(3000)
    one.add(keys[:3000])
    assert one.may_hold(keys[:3000]).all() and one.may_hold(keys[3000:]).mean() < 0.03
    assert len(exact_dedup.Filter(10**6, 1 << 12).words) == 64


def test_drop_copies_keeps_columns_and_nulls(spark):
    docs = frame(spark)
    left = exact_dedup.drop_copies(docs, "largest")
    assert left.columns == docs.columns
    assert len({r["text"] or "" for r in left.collect()}) == len({r[1] or "" for r in rows()})
    assert exact_dedup.groups(empty(spark)).count() == 0
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_near_groups_match_brute_force(spark):
    data = [r for r in rows() if r[0] is not None]
    wanted, full = brute_components(sets(data)), sets(data)
    got = near_dedup.groups(frame(spark)).collect()
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(full[r["doc_id"]]), wanted[r["doc_id"]], r["doc_id"] == wanted[r["doc_id"]])
    assert near_dedup.groups(empty(spark)).count() == 0
    assert near_dedup.drop_near_copies(frame(spark)).columns == frame(spark).columns


def test_an_identifier_with_several_texts_is_one_document(spark):
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcde")
    data = [(5, a), (5, b), (3, b), (7, a), (9, c), (9, d), (8, d.replace("d20", "x")), (2, c), (11, e), (11, a + " tail"), (4, e), (12, None), (12, c), (13, ""), (13, "")]
    got = near_dedup.groups(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r["doc_id"], r["component_id"]) for r in got) == Counter({(5, 3): 2, (3, 3): 1, (7, 3): 1, (9, 2): 2, (8, 2): 1, (2, 2): 1, (11, 3): 2, (4, 3): 1, (12, 2): 1, (12, 12): 1, (13, 13): 2})
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_groups_in_a_family_around_the_threshold(spark):
    """One text with many edits: some pairs are links, others just miss, all share buckets."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(200)]
    data = []
    for i in range(150):
        own = list(base)
        for at in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            own[at] = f"e{i}_{at}"
        data.append((i, " ".join(own)))
    wanted = brute_components(sets(data))
    got = near_dedup.groups(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted
    assert 1 < len(set(wanted.values())) < 150


def test_cells_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL_ELEMENTS", 800)
    monkeypatch.setattr(near_dedup, "MEMBER", 0)
    test_near_groups_in_a_family_around_the_threshold(spark)


def test_many_small_sets_that_share_a_shingle(spark):
    """Two shingles each, one of them everybody's: crowded buckets of small sets, and no link but between copies."""
    data = [(i, f"one two three four five w{i if i != 7 else 3}") for i in range(6000)]
    got = near_dedup.groups(spark.createDataFrame(data, "doc_id long, text string").repartition(5))
    assert [tuple(r) for r in got.where("not kept").collect()] == [(7, 2, 3, False)]


@pytest.mark.parametrize("query, decoy, link", [(9, (6, 0), (9, 3)), (395, (296, 0), (395, 131))], ids=["short", "long"])
def test_cell_finds_a_link_beside_a_decoy_of_another_length(query, decoy, link):
    """Sets of (shared with the query, own) elements: the decoy just misses the threshold, the other member of its component reaches it."""
    import pyarrow as pa

    own = [np.arange(query), np.r_[: decoy[0], 10_000 : 10_000 + decoy[1]], np.r_[: link[0], 20_000 : 20_000 + link[1]]]
    table = pa.table({
        "band": [1] * 3, "id": [5, 6, 7], "component": [5, 6, 6], "query": [True, False, False],
        "elements": [s.astype(np.uint64).tobytes() for s in own],
    })
    got = near_dedup._cell(table)
    assert list(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True)) == [(5, 7)]


def test_near_groups_of_families_of_different_lengths(spark):
    rng = np.random.default_rng(11)
    data = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(60)]
        for _ in range(60):
            own = base[: int(rng.integers(42, 61))]
            for at in rng.choice(len(own), int(rng.integers(0, 3)), replace=False):
                own[at] = f"e{len(data)}_{at}"
            data.append((len(data), " ".join(own)))
    wanted = brute_components(sets(data))
    got = near_dedup.groups(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == wanted
    assert 6 < len(set(wanted.values())) < 360


@pytest.mark.parametrize("n", [1, 2, 7, 60, 400, 5000])
def test_sketch_fills_every_coordinate_and_estimates_similarity(n):
    rng = np.random.default_rng(n)
    share = []
    for _ in range(20):
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[: n // 2], rng.integers(0, 2**63, n - n // 2, dtype=np.uint64)])
        a, b = near_dedup.sketch(np.unique(x)), near_dedup.sketch(np.unique(y))
        assert (a != near_dedup._EMPTY).all()
        share.append((a == b).mean())
    similarity = (n // 2) / (2 * n - n // 2)
    assert abs(np.mean(share) - similarity) < 0.06


def test_words_hash_like_their_lower_case_text():
    import pyarrow as pa

    texts = ["A b\tC\x0bd", None, "", "  lead é x ", "b a", "x" * 3_000_000 + " b"]
    words = Words(pa.array(texts))
    seen = {}
    for i, text in enumerate(texts):
        own = words.of(i)
        plain = words_of((text or "").translate(LOWER))
        assert len(own) == len(plain)
        for h, w in zip(own.tolist(), plain, strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_of_chains_and_stars(spark):
    long = [(1000 + k, 1001 + k) for k in range(3000)]
    got = {r["component"] for r in components(spark.createDataFrame(long, "a long, b long").repartition(3)).collect()}
    assert got == {1000}
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


PAGES = "page_id long, url string, html string, host string, lines int"


def test_line_dedup(spark):
    page = "<html><head><title>T{0}</title><script>var a='<p>';</script></head><body><nav>Menu</nav><!-- <p>no</p> --><p>Body {0} &amp; more</p><footer>Foot</footer></body></html>"
    data = [(i, f"https://User@Site.example:80/{i}", page.format(i), "x", 1) for i in range(10)]
    data += [(50, "http://small.example/", page.format(50), None, None), (51, None, "<p>free</p>", None, None), (52, "not a url", None, None, None), (53, "http://small.example/", "", None, None), (0, "https://site.example/", page.format(0), None, None)]
    got = line_dedup.cleaned(spark.createDataFrame(data, PAGES)).collect()
    by = {r["page_id"]: r for r in got if r["page_id"] != 0}
    assert len(got) == 15
    assert (by[3]["host"], by[3]["host_pages"], by[3]["n_lines"], by[3]["text"]) == ("site.example", 11, 4, "T3\nBody 3 & more")
    assert by[50]["text"] == "T50\nMenu\nBody 50 & more\nFoot" and by[50]["host_pages"] == 2
    assert (by[51]["host"], by[52]["text"], by[53]["n_lines"]) == ("", "", 0)
    assert line_dedup.cleaned(spark.createDataFrame([], PAGES)).count() == 0


def test_line_dedup_of_plain_text(spark):
    data = [(i, "http://h/", f"top\nown {i}\n  top \nend") for i in range(4)]
    got = line_dedup.cleaned(spark.createDataFrame(data, "page_id long, url string, body string"), text_col="body", html=False).collect()
    assert {r["text"] for r in got} == {f"own {i}" for i in range(4)}
    assert {r["n_lines"] for r in got} == {4}
