import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.llm import license_scan, lm_score, mixing, pii, quality_rules, sentencepiece_codec, toxicity

from .corpus import LOWER, SCHEMA, empty, frame, rows, words_of

MODEL = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


# Language model


def test_base_scores_match_brute_force(spark):
    data = rows()
    train = [r for r in data if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    docs = frame(spark)
    model = lm_score.fit(docs.where((F.crc32(F.col("doc_id").cast("string")) % 7 != 2)))
    got = lm_score.scored(docs, model, block_bytes=4000).collect()
    assert len(got) == len(data)

    def tokens(text):
        return [*words_of((text or "").translate(LOWER)), None]

    count = Counter(t for r in train for t in tokens(r[1]))
    total, kinds = sum(count.values()), len(count)
    text = {r[0]: r[1] for r in data if r[0] is not None}
    for r in got:
        if r["doc_id"] is None:
            continue
        own = tokens(text[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(t in count for t in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((count[t] + 1) / (total + kinds + 1)) for t in own), rel_tol=1e-9)
        assert r["score"] < 0
    assert lm_score.scored(empty(spark), model).count() == 0


def brute_score(model, text):
    """The model's log10 probability by its definition, token by token, with dictionaries and no batches."""
    w, rows = model.weights, {r["token"]: r for r in model.counts.collect()}
    t = lm_score.Tokens(pa.array([text]))
    start, total = int(lm_score.START), 0.0
    hashes = t.hash.tolist()

    def mix(x):
        return int(lm_score.mix(np.array([x % 2**64], np.uint64))[0])

    for k, token in enumerate(hashes):
        one, two, three = (hashes[k - j] if k >= j else start for j in (1, 2, 3))
        one = mix(one)
        skip, both = mix(two ^ 11), mix(one * 3 + two)
        logits = [float(x) for x in w.class_prior]
        for f in (one, both, skip, mix(three ^ 13)):
            logits = [a + float(b) for a, b in zip(logits, w.wide[f % lm_score.FEATURES], strict=True)]
        before = rows.get(np.uint64(hashes[k - 1]).view(np.int64).item()) if k else None
        if before is not None and before["weights"] is not None:
            logits = [a + b / lm_score.UNITS for a, b in zip(logits, np.frombuffer(before["weights"], np.int8).tolist(), strict=True)]
        kind, leaf = divmod(int(t.leaf[k]), lm_score.CLASSES)
        under = [float(x) for x in w.leaf_prior[kind]]
        for f in (one >> 20, skip >> 20):
            under = [a + float(b) for a, b in zip(under, w.narrow[f % lm_score.LEAF_FEATURES * lm_score.CLASSES + kind], strict=True)]
        p, q = (np.exp(x) / np.exp(x).sum() for x in (np.array(logits), np.array(under)))
        own = rows.get(np.uint64(token).view(np.int64).item())
        total += math.log10(p[kind] * q[leaf] * ((own["n"] if own else 0) + 1) / w.mass[t.leaf[k]])
    return total


def test_scores_match_brute_force_and_context_helps(spark):
    random.seed(5)
    tongues = [["ab", "cd", "ef"], ["xy", "zw", "uv"]]
    data = [(i, " ".join(random.choices(tongues[i % 2], k=30))) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    model = lm_score.fit(docs)
    counts = {r["token"]: r for r in model.counts.collect()}
    assert sum(r["n"] for r in counts.values()) == model.tokens and len(counts) == model.kinds
    assert sum(r["weights"] is not None for r in counts.values()) == 6
    assert model.gains == sorted(model.gains) and len(model.gains) > 1
    extra = [(1000, "Zz new words ab ab"), (1001, None), (1002, ""), (1003, "ab"), (1003, "ab")]
    every = docs.union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = lm_score.scored(every, model).toPandas()
    assert len(got) == len(data) + len(extra)
    text = dict(data + extra)
    for r in got.itertuples():
        if r.doc_id >= 1000 or r.doc_id % 40 == 0:
            assert math.isclose(r.score, brute_score(model, text[r.doc_id] or ""), rel_tol=1e-4), r.doc_id
    known = got[got["doc_id"] < 1000]
    assert known["score"].sum() > 0.8 * known["base_score"].sum()
    assert (known["score"] > known["base_score"]).mean() > 0.95


def test_probabilities_sum_to_one_over_a_whole_vocabulary(spark):
    """All words that may follow, and one for what is unknown in each leaf."""
    model = lm_score.fit(frame(spark))
    w = model.weights
    tokens = {w_ for r in rows() for w_ in words_of((r[1] or "").translate(LOWER))}
    n = Counter(w_ for r in rows() for w_ in words_of((r[1] or "").translate(LOWER)))
    n[None] = len(rows())
    leaf_of = {w_: int(lm_score.Tokens(pa.array([w_])).leaf[0]) for w_ in tokens} | {None: 0}
    inside = Counter()
    for w_, k in leaf_of.items():
        inside[k] += (n[w_] + 1) / w.mass[k]
    for k in range(lm_score.LEAVES):
        assert math.isclose(inside[k] + 1 / w.mass[k], 1, rel_tol=1e-9)
    t = lm_score.Tokens(pa.array([rows()[0][1]]))
    _, _, p, _, q = next(lm_score._predict(w, t))
    assert np.allclose(p.sum(1), 1, atol=1e-5) and np.allclose(q.sum(1), 1, atol=1e-5)


def test_features_grow_with_the_corpus(spark):
    def many(n):
        docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat(F.lit(f"w{k}_"), (F.col("id") / 10).cast("int")) for k in range(4))).alias("text"))
        return lm_score.fit(docs).counts.where("weights is not null").count()

    assert many(400) > 3 * many(100) > 0


def test_model_of_nothing(spark):
    model = lm_score.fit(empty(spark))
    got = lm_score.scored(frame(spark), model).collect()
    assert {r["n_known"] for r in got} == {0} and {r["train_tokens"] for r in got} == {0}


# Quality rules


def test_measures_match_brute_force(spark):
    got = quality_rules.verdicts(quality_rules.ledger(frame(spark))).collect()
    text = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    assert len(got) == len(rows())
    for r in got:
        if r["doc_id"] is None:
            continue
        t = text[r["doc_id"]]
        w = words_of(t)
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        seen = Counter(windows)
        again = {k + j for k, x in enumerate(windows) if seen[x] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(again))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert r["kept"] <= (not r["base_failed"])
    assert quality_rules.ledger(empty(spark)).count() == 0


def test_policies_and_ablations_are_bitwise(spark):
    bad = [(1, "a " * 40), (2, "few"), (3, " ".join(f"w{k} ***" for k in range(20))), (4, " ".join(f"word{k}" for k in range(30)))]
    rows_ = quality_rules.ledger(spark.createDataFrame(bad, "doc_id long, text string"))
    kept = {p: {r["doc_id"] for r in quality_rules.verdicts(rows_, p).where("kept").collect()} for p in quality_rules.POLICIES}
    assert kept == {"base": {3, 4}, "v1": {4}, "v2": {4}}
    table = {(r["policy"], r["rule"]): r for r in quality_rules.ablations(rows_).collect()}
    r = table["v1", "symbols"]
    assert (r["kept"], r["failed"], r["failed_alone"], r["kept_without"]) == (1, 1, 1, 2)


# SentencePiece


def test_encoding_equals_the_library_and_spans_tile_the_text(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = {r[0]: r[1] or "" for r in rows() if r[0] is not None} | {900: "a  b\t▁c 漢字 \U0001f600 é\x00x"}
    docs = frame(spark).unionByName(spark.createDataFrame([(900, text[900])], "doc_id long, text string"), allowMissingColumns=True)
    got = sentencepiece_codec.encoded(docs, MODEL, spans=True).collect()
    assert len(got) == len(rows()) + 1
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = text[r["doc_id"]].encode()
        ids = library.encode(text[r["doc_id"]], add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
        assert r["n_bytes"] == len(raw)
        assert [*r["begins"], len(raw)] == [0, *r["ends"]][: len(ids)] + [len(raw)]
        if len(raw) < 3000:
            pieces = [p.encode().replace("▁".encode(), b" ") for p in library.encode(raw.decode(), out_type=str)]
            if pieces:
                pieces[0] = pieces[0][1:]  # the mark before the text stands for no byte of it
            for piece, a, b in zip(pieces, r["begins"], r["ends"], strict=False):
                assert piece.startswith(b"<0x") or raw[a:b].replace("▁".encode(), b" ") == piece
    digest = sentencepiece_codec.digests(sentencepiece_codec.encoded(docs, MODEL)).where("doc_id = 900").first()
    ids = library.encode(text[900], add_eos=True)
    assert digest["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sentencepiece_codec.encoded(empty(spark), MODEL).count() == 0


@pytest.fixture(scope="module")
def variants(tmp_path_factory):
    """The model as it is; with a non-empty character map and squeezed blanks; and without byte pieces, with fixed and unused pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    folder, kinds = tmp_path_factory.mktemp("models"), pb.ModelProto.SentencePiece
    mapped, plain = pb.ModelProto(), pb.ModelProto()
    for proto in (mapped, plain):
        with open(MODEL, "rb") as file:
            proto.ParseFromString(file.read())
    spec = pb.ModelProto()
    spec.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    mapped.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    mapped.normalizer_spec.remove_extra_whitespaces = True
    plain.trainer_spec.byte_fallback = False
    for k, p in enumerate(plain.pieces):
        if p.type == kinds.BYTE:
            p.type = kinds.USER_DEFINED
        if k % 7 == 3 and p.type == kinds.NORMAL and len(p.piece) > 1:
            p.type = kinds.UNUSED
    for word in ("ab", "abc", "#"):
        plain.pieces.add(piece=word + "@", score=0.0, type=kinds.USER_DEFINED)
    plain.normalizer_spec.precompiled_charsmap = spec.normalizer_spec.precompiled_charsmap
    out = [MODEL]
    for name, proto in (("mapped", mapped), ("plain", plain)):
        (folder / name).write_bytes(proto.SerializeToString())
        out.append(str(folder / name))
    return out


ODD = [
    "", " ", "   x", "a  b\t▁c 漢字 \U0001f600 é\x00x", "ﬁ ½ Ａ１ ①② x² …", "e\u0301 q  r   ", "abc@ab@abcc@#@ <0x41> </s> <s>", "\u3000\u3000x\u3000y", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa",
    "漢字漢字 漢 字", "x" * 70 + "漢" * 70, "¨ ´ ﷺ", "\n\n\r\n", "tabs\tand\x0bfeeds", "Ünïcödé ﬀ", "end ▁ ▁▁ ", "▁ x",
]


def test_own_encoding_and_decoding_equal_the_library_for_every_model(variants):
    import sentencepiece

    random.seed(3)
    letters = "abcdefghijklmnopqrstuvwxyz  ▁éßñ漢ﬁ½0123<>@#\u0301\U0001f600"
    texts = ODD + ["".join(random.choices(letters, k=random.randint(1, 80))) for _ in range(400)]
    for path in variants:
        library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
        for text in texts:
            ids, begins, ends = own.encode(text.encode())
            want = library.encode(text, return_type="proto")
            assert ids.tolist() == [*(p.id for p in want.pieces), library.eos_id()], (path, text)
            assert own.decode(ids) == library.decode(ids.tolist()), (path, text)
            spans = [(p.begin, p.end) for p in want.pieces if not library.is_byte(p.id)]
            mine = [(a, b) for i, a, b in zip(ids.tolist(), begins.tolist(), ends.tolist(), strict=True) if i != library.eos_id() and not library.is_byte(i)]
            assert mine == spans, (path, text)
    own = sentencepiece_codec.Codec(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for _ in range(300):
        ids = [random.choice([random.randrange(3, 259), random.randrange(32000), 0, 2]) for _ in range(6)]
        assert own.decode(np.array(ids)) == library.decode(ids), ids


def compiled(table):
    """A character map with a double-array trie of the given prefixes, built naively."""
    forms, at = b"", {}
    for key, form in table.items():
        at[key] = len(forms)
        forms += form + b"\0"
    nodes, units, taken = {b""}, [0] * 70_000, {0}
    for key in table:
        nodes |= {key[:k] for k in range(len(key) + 1)}
    place, free = {b"": 0}, 256

    for node in sorted(nodes, key=len):
        children = sorted({n[len(node)] for n in nodes if len(n) == len(node) + 1 and n.startswith(node)})
        base = free
        while any(base ^ c in taken for c in [*children, 0]):
            base += 256
        here = place[node]
        units[here] = (units[here] & 0x800000FF) | ((here ^ base) << 10) | ((node in table) << 8)
        taken.add(base)
        if node in table:
            units[base] = 0x80000000 | at[node]
        for c in children:
            place[node + bytes([c])] = base ^ c
            taken.add(base ^ c)
            units[base ^ c] = c
        free = base + 256
    blob = np.array(units[: max(taken) + 1], np.uint32).tobytes()
    return len(blob).to_bytes(4, "little") + blob + forms


def test_longest_prefix_normalisation_keeps_alignment():
    spec = sentencepiece_codec.sentencepiece_model_pb2.NormalizerSpec()
    spec.precompiled_charsmap = compiled({"ﬁ".encode(): b"fi", b"ab": b"X", b"abc": b"YZ", "é".encode(): b"e", "　".encode(): b" "})
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = False, False, True
    normalise = sentencepiece_codec.Normaliser(spec)
    out, origin = normalise("zabcabé　ﬁ!".encode())
    assert out.decode() == "zYZXe▁fi!"
    assert origin.tolist() == [0, 1, 1, 4, 6, 8, 8, 8, 11, 11, 14, 15]
    spec.remove_extra_whitespaces, spec.add_dummy_prefix = True, True
    out, origin = sentencepiece_codec.Normaliser(spec)(b"  q  r ")
    assert out.decode() == "▁q▁r" and origin.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]
    assert sentencepiece_codec.Normaliser(spec)(b"   ")[0] == b""


# Mixing


def test_mixture_meets_targets_and_the_tree_is_exact(spark):
    random.seed(2)
    data = [(i, "w " * random.randint(1, 30), ["a", "b", "c", "d", None][min(4, int(random.random() ** 3 * 6))]) for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mixture(docs).toPandas()
    assert len(got) == len(data)
    source = {i: s for i, _, s in data}
    got["source"] = [source[i] for i in got["doc_id"]]
    total = got["size"].sum()
    assert math.isclose(got.groupby("source", dropna=False)["target"].first().sum(), total, rel_tol=1e-9)
    for _, part in got.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
        assert (part["taken"] <= 3 * part["size"]).all() and part["target"].iloc[0] <= 3 * part["source_size"].iloc[0] + 1e-6
    again = mixing.mixture(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert again.equals(got.drop(columns="source").sort_values("doc_id").reset_index(drop=True))
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.count() == got["copies"].sum()
    shards = mixing.sharded(docs, mixing.mixture(docs))
    assert shards.count() == got["copies"].sum() and shards.select("shard").distinct().count() == 16


def test_split_gives_equal_disjoint_shards(spark):
    draws = spark.range(1003).selectExpr("cast(id % 3 as string) source", "cast(id as string) block", "cast(id % 2 as int) pass")
    got = mixing.split(draws, 3).toPandas()
    sizes = got["shard"].value_counts()
    assert len(got) == 1003 and len(sizes) == 8 and sizes.max() - sizes.min() <= 1
    share = got[got["source"] == "0"]["shard"].value_counts()
    assert share.min() > 20 and share.max() < 65


def test_targets_pour_over_caps(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000), ("c", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    # Weights a 5, b 2, c 1, null 5: a fills at 30, c at 0, and the other 1980 are shared 2 to 5.
    assert got["a"] == 30 and got["c"] == 0
    assert math.isclose(got["b"], 1980 * 2 / 7) and math.isclose(got[None], 1980 * 5 / 7)


def test_mixture_of_awkward_rows(spark):
    got = mixing.mixture(frame(spark)).collect()
    assert len(got) == len(rows())
    assert all(r["taken"] == r["size"] * r["copies"] for r in got)
    assert mixing.mixture(empty(spark)).count() == 0
    assert mixing.mixed(empty(spark)).count() == 0
    assert mixing.mixture(frame(spark).where("text is null")).where("taken > 0").count() == 0
    clash = frame(spark).withColumns({n: F.lit(1) for n in ("__n", "__key", "__size", "__copies", "__copy", "shard", "key")})
    assert mixing.mixed(clash).columns == clash.columns
    assert mixing.sharded(clash, mixing.mixture(clash)).columns == [*clash.columns, "shard_"]
    nameless = spark.createDataFrame([(None, f"a b {i}", "s") for i in range(200)], "doc_id long, text string, source string")
    assert mixing.sized(nameless).select("key").distinct().count() == 200


def test_blocks_and_shards_follow_the_size():
    assert mixing.scale(10**6, 3) == (2, 4)
    assert mixing.scale(10**11, 5) == (3, 9) and mixing.scale(10**13, 5) == (4, 16)
    assert mixing.scale(10**18, 5) == (4, 17)


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if good(kind, m[0])]


def test_entities_match_the_patterns():
    fixed = ["a@b.c.d@e.f x@y", "@a.b a@@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.0256 001.2.3.4", "é4111 1111-1111 1111é", "+1 (555) 010-9999 +1+49 30 1234567", "", "a..@-.-", "1" * 5000 + ".1.1.1", "x" * 5000]
    random.seed(4)
    fixed += ["".join(random.choices("0123459.@+ -ab()é", k=80)) for _ in range(3000)]
    for text in fixed:
        assert pii.entities(text) == brute_spans(text), text


def test_disclosing_terms_are_spans(spark):
    random.seed(1)
    filler = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(200)]

    def text(*extra):
        w = random.choices(filler, k=30)
        w[15:15] = extra
        return " ".join(w)

    data = [(i, text("Zorbly,", "anna@site.example")) for i in range(12)] + [(100 + i, text()) for i in range(200)] + [(400, text("zorbly")), (401, None), (402, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.detected(docs).collect()}
    for i in range(12):
        a = data[i][1].index("Zorbly")
        assert (4, a, a + 6) in [tuple(s) for s in got[i]["spans"]]
        assert sum(s["kind"] == 4 for s in got[i]["spans"]) == 1
    assert [s["kind"] for s in got[400]["spans"]] == [4]
    assert all(not got[i]["spans"] for i in range(100, 300)) and not got[401]["spans"] and not got[402]["spans"]
    clash = docs.withColumns({n: F.lit(1) for n in ("key", "__key", "spans", "bits", "of", "k", "doc", "found", "__spans")})
    assert pii.sanitised(clash).columns == clash.columns
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(clash).collect()}
    assert "anna" not in clean[3] and "Zorbly" not in clean[3] and clean[3].count("[EMAIL]") == 2 and clean[401] is None and clean[150] == dict(data)[150]
    table = {r["doc_id"]: r for r in pii.summary(pii.detected(docs)).collect()}
    assert table[402]["base_sha256"] == hashlib.sha256(b"").hexdigest() and table[402]["spans"] == ""


def test_counts_of_each_kind_wherever_its_spans_stand(spark):
    """Spans are in one array by kind: a count must go by their kind, not by their place."""
    texts = ["a@b.cc d@e.ff g@h.ii", "10.0.0.1 +49 (30) 1234567", "4111 1111 1111 1111", "a@b.cc 1.2.3.4", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = {r["doc_id"]: r for r in pii.summary(pii.detected(docs)).collect()}
    for i, text in enumerate(texts):
        spans = brute_spans(text)
        assert [table[i][f"n_{name}"] for name in pii.KINDS[:4]] == [sum(s[0] == k for s in spans) for k in range(4)], text
        plain = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert table[i]["base_sha256"] == hashlib.sha256(plain.encode()).hexdigest()


def test_terms_disclose_rare_values_and_kinds_from_anywhere_in_a_text(spark):
    random.seed(2)
    filler = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(200)]

    def text(first="", last=""):
        return " ".join([first, *random.choices(filler, k=40), last])

    data = [(i, text("Quorbal", f"own{i}@site{i}.example")) for i in range(8)]
    data += [(20 + i, text("Vintrel", "10.1.2.3")) for i in range(2)]
    data += [(30 + i, t) for t in [text("Drusket", "+49 30 1234567")] for i in range(6)]
    data += [(100 + i, text()) for i in range(300)]
    got = {r["doc_id"]: r["spans"] for r in pii.detected(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, body in data:
        terms = [body[s["start"] : s["end"]] for s in got[i] if s["kind"] == 4]
        # The last one stands in one text only, however often that is copied.
        assert terms == [w for w in body.split() if w.lower() in ("vintrel", "quorbal")], i


def brute_terms(data):
    """Term spans by their definition: every term against every entity and kind, over distinct texts."""
    texts = sorted({t or "" for _, t in data})
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def terms(text, spans=()):
        out = []
        for m in word.finditer(text):
            a, b = m.span()
            for _ in range(4):
                a += b > a + 1 and text[a].isascii() and not text[a].isalnum()
                b -= b > a + 1 and text[b - 1].isascii() and not text[b - 1].isalnum()
            t = text[a:b].translate(LOWER)
            inside = any(len(text[:x].encode()) < len(text[:b].encode()) and a < y for _, x, y in spans)
            if len(t.encode()) >= 3 and not re.search("[0-9]", t) and not inside:
                out.append((t, a, b))
        return out

    have = {}
    for text in texts:
        spans = brute_spans(text)
        known = {("kind", k) for k, _, _ in spans} | {(k, text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])) for k, a, b in spans}
        have[text] = known, {t for t, _, _ in terms(text, spans)}
    docs = Counter(t for text in texts for t in {t for t, _, _ in terms(text)})
    with_ = Counter(e for known, _ in have.values() for e in known)
    both = Counter((t, e) for known, own in have.values() for e in known for t in own)
    pairs = sum(len(known) * len(own) for known, own in have.values())
    good = set()
    for (t, e), n in both.items():
        base, own = with_[e] / len(texts), n / docs[t]
        divergence = own * math.log(own / base) + ((1 - own) * math.log((1 - own) / (1 - base)) if own < 1 else 0)
        if pairs * math.exp(-docs[t] * divergence) > pii.MOST_FALSE:
            continue
        share = (n + pii.SMOOTHING * base) / (docs[t] + pii.SMOOTHING)
        if n > 1 and with_[e] * 2**pii.LEAST_BITS <= len(texts) and share >= pii.LEAST_SHARE and math.log2(share / base) >= pii.LEAST_BITS:
            good.add(t)
    return [(i, [(4, a, b) for t, a, b in terms(text or "") if t in good]) for i, text in data], good


def test_term_spans_equal_brute_force_with_copies_and_ties(spark):
    random.seed(12)
    filler = [f"v{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    people = [(f"Name{chr(97 + k)}el", f"p{k}@mail.example", f"+49 30 12345{k:02}") for k in range(6)]
    data = []
    for i in range(400):
        w = random.choices(filler, k=random.randint(3, 30))
        if i % 20 < 2:
            name, mail, phone = people[i % 6]
            w[1:1] = [f"({name})"] * random.randint(0, 2) + [mail] * (i % 3 > 0) + [phone] * (i % 3 < 2)
        data.append((i, " ".join(w)))
    data += [(1000 + k, data[k % 40][1]) for k in range(90)] + [(2000, None), (2001, ""), (3, data[3][1])]
    wanted, good = brute_terms(data)
    assert good
    got = pii.detected(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    terms = [(r["doc_id"], tuple(tuple(s) for s in r["spans"] if s["kind"] == 4)) for r in got]
    assert Counter(terms) == Counter((i, tuple(s)) for i, s in wanted)


def test_terms_of_two_texts_are_no_finding_by_chance(spark):
    """A third of the texts have an address of their own; words stand in two texts each, whose kinds agree often enough."""
    random.seed(21)
    data = []
    for i in range(1200):
        words = [f"z{''.join(chr(97 + int(c)) for c in str((i * 7 + k * 131) % 6000))}q" for k in range(10)]
        data.append((i, " ".join([*words, *([f"q{i}@mail.example"] if i % 30 == 0 else []), *(["Overt", "q@same.example"] if i % 100 == 7 else [])])))
    got = pii.detected(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    found = {dict(data)[r["doc_id"]][s["start"] : s["end"]] for r in got for s in r["spans"] if s["kind"] == 4}
    assert found == {"Overt"}


def test_a_list_of_contacts_counts_as_one_value(spark):
    """Two texts with the same two thousand addresses and a word of their own, among others: what they disclose is found, in rows by text and not by address."""
    random.seed(22)
    mails = " ".join(f"m{k}@list.example" for k in range(2000))
    data = [(i, f"{mails} Kestrelby and {i}") for i in range(2)] + [(10 + i, " ".join(random.choices(["alpha", "beta", "gamma", "and"], k=20))) for i in range(400)]
    got = {r["doc_id"]: r["spans"] for r in pii.detected(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i in range(2):
        assert [data[i][1][s["start"] : s["end"]] for s in got[i] if s["kind"] == 4] == ["Kestrelby"] and sum(s["kind"] == 0 for s in got[i]) == 2000


def test_detection_of_awkward_rows(spark):
    assert pii.detected(frame(spark)).count() == len(rows())
    assert pii.detected(empty(spark)).count() == 0
    assert pii.sanitised(frame(spark)).columns == frame(spark).columns


# Toxicity


def toxic_corpus(n=900):
    random.seed(9)
    filler = ["the", "and", "lorem", "ipsum", "dolor", "not", "sit", "amet", "du", "elit", "sed"]
    data, labels = [], []
    for i in range(n):
        w = random.choices(filler, k=random.randint(5, 80))
        bad = i % 6 == 0
        if bad:
            w[random.randrange(len(w))] = random.choice(["Blorgest", "blorging!", "snib"])
        data.append((i, " ".join(w) + "."))
        labels.append((i, 1, int(bad)))
    return data, labels


def test_toxicity_learns_words_and_stems(spark):
    data, labels = toxic_corpus()
    docs = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert any(e.startswith("blor") for e in model.entries)
    extra = spark.createDataFrame([(5000, "a blorgable thing"), (5001, None), (5002, ""), (None, "snib")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(docs.union(extra), model).collect()}
    held = [i for i, _ in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i, _ in data)
    assert sum(got[i]["predicted"] == int(i % 6 == 0) for i in held) >= 0.98 * len(held)
    assert got[5000]["predicted"] == 1 and got[5001]["predicted"] == got[5002]["predicted"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, _ in data if not got[i]["predicted"]}


def test_toxicity_without_labels_and_with_awkward_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark), none)
    assert toxicity.scored(frame(spark), model).count() == len(rows())
    assert toxicity.scored(empty(spark), model).count() == 0
    assert toxicity.drop_toxic(frame(spark), model).count() == len(rows())
    lone = spark.createDataFrame([(3, 1, 1), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(frame(spark), lone).entries.keys() == model.entries.keys()


def test_clause_grammar_tells_contexts_apart():
    lexicon = toxicity.Lexicon({"=idiot": 3.0})

    def where(text):
        x = dict(zip(toxicity.FEATURES, toxicity.clauses(text, lexicon), strict=True))
        return {k.split("_")[0] for k, v in x.items() if k.endswith("most") and v}

    assert where("what an idiot") == {"plain"}
    assert where("you are an idiot") == {"aimed"}
    assert where("he is not an idiot") == {"negated"}
    assert where("she said: it. he said you idiot") == {"reported"}
    assert where("not now. an idiot") == {"plain"}
    assert where("") == set()
    x = dict(zip(toxicity.FEATURES, toxicity.clauses("i will kill you. you will kill", lexicon), strict=True))
    assert x["threat"] == 3.0 and x["clauses"] > 0


@pytest.mark.parametrize("text", ["i will kill you", "you i will kill", "wir töten dich", "dich töten wir", "tuer vous tous", "vous tuer tous", "voy a matar a usted", "a usted voy a matar"])
def test_threats_meet_their_target_in_either_order(text):
    x = dict(zip(toxicity.FEATURES, toxicity.clauses(text, toxicity.Lexicon({})), strict=True))
    assert x["threat"] == 3.0 and x["clauses"] == math.log1p(1)


def test_targets_behind_a_hit_count_within_four_words_of_its_clause():
    lexicon = toxicity.Lexicon({"=idiot": 3.0})

    def values(text):
        return dict(zip(toxicity.FEATURES, toxicity.clauses(text, lexicon), strict=True))

    assert values("idiot, you")["aimed_most"] == values("idiot a b c you")["aimed_most"] == 3.0
    assert values("idiot a b c d you")["plain_most"] == values("idiot. you")["plain_most"] == 3.0
    assert values("never an idiot like you")["negated_most"] == 3.0
    assert values("i will not kill you")["threat"] == values("i kill time. you")["threat"] == values("to kill a b c d you")["threat"] == 0


def test_best_path_equals_the_best_of_all_readings():
    """All sequences of readings, each checked against the rules in words, not against the machine."""
    from itertools import product

    def worth(clause, readings):
        total, out = 0.0, []
        for i, (kind, weight) in enumerate(clause):
            if kind not in toxicity.READINGS or readings[i] == "other":
                continue
            before = any(k == "target" for k, _ in clause[max(0, i - 4) : i])
            after = any(k == "target" for k, _ in clause[i + 1 : i + 5])
            if readings[i].endswith(">") and not after or readings[i] == "threat" and not before:
                return None
            reported = any(k in ("report", "quote") for k, _ in clause[:i])
            negated = any(k == "negation" for k, _ in clause[max(0, i - 3) : i])
            where = "reported" if reported else "negated" if negated else "aimed" if before or readings[i].endswith(">") else "plain"
            total += weight * toxicity.FACTORS[where]
            out.append((kind, where, weight))
        return total, out

    random.seed(8)
    kinds = ["other"] * 3 + ["insult", "threat", "target", "negation", "report", "quote"]
    for _ in range(400):
        clause = [(k, random.choice([1.0, 2.5]) if k in toxicity.READINGS else 0.0) for k in random.choices(kinds, k=random.randint(0, 7))]
        every = [worth(clause, r) for r in product(*(toxicity.READINGS.get(k, (k,)) for k, _ in clause))]
        best = max((v[0] for v in every if v), default=0.0)
        got = toxicity.best_path(clause)
        assert math.isclose(sum(w * toxicity.FACTORS[where] for _, where, w in got), best), clause
        assert got in [v[1] for v in every if v]
    assert len(toxicity.best_path([("insult", 1.0)] * 20_000)) == 20_000


# Licences


def brute_alignment(template, text):
    """Matched words of the best local alignment over the whole table."""
    best, before = (0, 0), [(0, 0)] * (len(text) + 1)
    for a in template:
        now = [(0, 0)]
        for j, b in enumerate(text):
            take = (before[j][0] + (2 if a == b else -1), before[j][1] + (a == b))
            cell = max(take, (before[j + 1][0] - 1, before[j + 1][1]), (now[j][0] - 1, now[j][1]))
            now.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, now[-1])
        before = now
    return best[1]


def test_banded_alignment_equals_the_full_one():
    rng = np.random.default_rng(6)
    for _ in range(60):
        template = rng.integers(0, 50, 30)
        text = np.concatenate([rng.integers(100, 200, 20), np.delete(template, rng.choice(30, 3, replace=False)), rng.integers(100, 200, 20)])
        matched, start, end = license_scan.align(template, text, 20)
        assert matched == brute_alignment(template.tolist(), text.tolist())
        assert 20 <= start < end <= len(text) - 20


def test_licences_are_found_whole_and_edited(spark):
    names = list(license_scan.TEMPLATES)
    words = "lorem ipsum dolor sit amet consectetur".split()
    data = []
    for i, name in enumerate(names):
        body = " ".join(words) + "\n# " + license_scan.TEMPLATES[name].replace(" ", "\n *  ", 1).upper() + "\n" + " ".join(words)
        data.append((i, body))
    long = license_scan.TEMPLATES["MIT/grant"].split()
    data += [(100, " ".join([*words, *long[:20], "really", *long[22:]])), (101, " ".join(long[:12])), (102, "all rights reversed"), (103, None), (104, "")]
    got = {r["doc_id"]: r["matches"] for r in license_scan.scanned(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    for i, name in enumerate(names):
        assert name in [m["license"] for m in got[i]], name
        match = next(m for m in got[i] if m["license"] == name)
        assert match["coverage"] == 1.0
        assert data[i][1][match["start"] : match["end"]].split()[-1].strip("./").lower() == license_scan.TEMPLATES[name].split()[-1].strip("./").lower()
    assert [m["license"] for m in got[100]] == ["MIT/grant"] and 0.9 < got[100][0]["coverage"] < 1
    assert not got[101] and not got[102] and not got[103] and not got[104]


def test_licences_that_repeat_are_all_found(spark):
    mit, short, long = (license_scan.TEMPLATES[n] for n in ("MIT", "Proprietary", "MIT/grant"))
    data = [
        (0, " ".join([short] * 2), ["Proprietary"] * 2), (1, " ".join([mit] * 2), ["MIT"] * 2), (2, " ".join([mit] * 40), ["MIT"] * 40),
        (3, f"{short} {short} and {mit} {long} {short} {long}", ["Proprietary", "Proprietary", "MIT", "MIT/grant", "Proprietary", "MIT/grant"]),
    ]
    words = mit.split()
    data += [(10 + k, f"lorem {' '.join([*words[:k], 'other', *words[k + 1:]])} ipsum", ["MIT"]) for k in range(len(words))]
    got = {r["doc_id"]: r["matches"] for r in license_scan.scanned(spark.createDataFrame([d[:2] for d in data], "doc_id long, text string")).collect()}
    for i, _, wanted in data:
        assert [m["license"] for m in got[i]] == wanted, i
    assert [m["start"] for m in got[2]] == [k * (len(mit) + 1) for k in range(40)]


def test_licence_scan_of_awkward_rows(spark):
    assert license_scan.summary(license_scan.scanned(frame(spark))).count() == len(rows())
    assert license_scan.scanned(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        license_scan.Index({"x": "too short"})


@pytest.mark.parametrize("n", [1, 3, 4, 5, 40])
def test_winnowing_covers_every_window(n):
    h = np.random.default_rng(n).integers(0, 2**60, n, dtype=np.uint64)
    at = license_scan.winnow(h)
    assert all(((at >= k) & (at < k + license_scan.WINDOW)).any() for k in range(max(1, n - license_scan.WINDOW + 1)))


# Pipeline


def brute_mix(docs):
    """How often each of (identifier, text, source) is taken: targets by sharing again and again, whole passes, then blocks in permuted order."""
    size = {i: len(words_of(t)) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    target, left, open_ = dict.fromkeys(sources, 0.0), float(sum(total.values())), set(sources)
    while open_ and left > 1e-9:
        share = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if target[s] + share * weight[s] >= 3 * total[s]}
        for s in full or open_:
            more = 3 * total[s] - target[s] if s in full else share * weight[s]
            target[s] += more
            left -= more
        open_ -= full
        if not full:
            break

    def md5(*parts):
        return hashlib.md5("|".join(p for p in parts if p is not None).encode()).hexdigest()

    copies = {}
    for s in sources:
        own = [(md5(str(i), "mix"), i) for i, _, x in docs if x == s]
        passes = min(3, int(target[s] // total[s])) if total[s] else 0
        rest, taken = target[s] - passes * total[s], 0
        for block in sorted({k[:2] for k, _ in own}, key=lambda b: (md5(s, b, "mix"), b)):
            left_here, so_far = rest - taken, 0
            here = sorted(x for x in own if x[0][:2] == block)
            for _, i in here:
                so_far += size[i]
                inside = left_here > 0 and (left_here >= sum(size[j] for _, j in here) or so_far - size[i] / 2 <= left_here)
                copies[i] = passes + inside if total[s] else 0
            taken += so_far
    return copies


def brute_pipeline(docs, model):
    """The rows of the whole pipeline, stage by stage in plain Python; only the fitted toxicity model is given."""
    import sentencepiece

    from .test_dedup import brute_components, sets

    lexicon = toxicity.Lexicon(model.entries)
    now = [(i, t or "", s) for i, t, _, s, _ in docs if model.score(toxicity.clauses(t or "", lexicon)) < 0.5]
    last = {}
    for i, t, _ in sorted(now, key=lambda r: r[0]):
        last[t] = i
    now = [r for r in now if last[r[1]] == r[0]]
    group = brute_components(sets(now))
    now = [r for r in now if group[r[0]] == r[0]]
    copies, library = brute_mix(now), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    out = Counter()
    for i, t, _ in now:
        ids = library.encode(t, add_eos=True)
        out[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += copies[i]
    return +out


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    data, labels = toxic_corpus(600)
    extra = rows(12)
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in data] + [(10_000 + k, r[1], r[2], r[3], 0) for k, r in enumerate(extra)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    assert SCHEMA.startswith(schema)
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    text = {d[0]: d[1] or "" for d in docs}
    results = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        results.append(now)
        if name != "sentencepiece":
            assert now.columns == [c.split()[0] for c in schema.split(", ")]
    toxic, exact, near, mix, pieces = ([r["doc_id"] for r in x.collect()] for x in results)
    assert not {i for i in toxic if i < 600 and i % 6 == 0}
    assert len(exact) == len({text[i] for i in toxic}) and set(exact) <= set(toxic)
    assert set(near) <= set(exact) and len(near) == len(set(near))
    assert set(mix) <= set(near) and len(pieces) == len(mix)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    wanted = brute_pipeline(docs, model)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == wanted
    assert len(wanted) > 100 and max(wanted.values()) > 1


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
