import bisect
import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from conftest import SF
from helpers import AWKWARD, LONG, docs, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import ann, byte_bpe, components, jpeg, lang_id, line_dedup, media, packing, simhash, substring_dedup, token_store, toxicity
from quillon.llm.wordcodec import WordCodec

WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def awkward(spark):
    return docs(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 1 ------------------------------------------------------------------------------------------------


def test_line_dedup_is_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(map(tuple, con.execute(line_dedup.SQL).fetchall()))
    assert sorted(map(tuple, line_dedup.repeated_lines(table(spark, "documents")).collect())) == want


def test_line_dedup_edges(spark, awkward, empty):
    got = line_dedup.repeated_lines(awkward)
    assert got.count() == len(AWKWARD) and line_dedup.repeated_lines(empty).count() == 0
    by = {r["doc_id"]: r for r in got.collect()}
    assert (by[2]["n_lines"], by[3]["n_lines"], by[9]["n_removed"]) == (0, 1, 0)


def test_line_dedup_removes_later_chunks(spark):
    body = "\n".join(f"line {i} of a passage" for i in range(30))
    df = docs(spark, [(1, "intro one\n" + body), (2, "other start\nand more\n" + body + "\ntail"), (3, body), (4, None)])
    out = {r["doc_id"]: r["text"] for r in line_dedup.drop_repeated_lines(df).collect()}
    assert out[1] == "intro one\n" + body and out[4] is None
    assert len(out[2].split("\n")) < 15 and "other start" in out[2] and len(out[3].split("\n")) < 15
    assert line_dedup.drop_repeated_lines(df).columns == df.columns


def test_chunks_keep_every_line():
    for text in (b"", b"a", b"a\nb\n", b"\n".join(b"%d" % (i % 7) for i in range(100))):
        assert b"\n".join(x for c in line_dedup.chunks(text) for x in c) == text


# 2 ------------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    d = table(spark, "documents")
    got = lang_id.identify_held_out(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 30 and (got["lang"] == got["lang_pred"]).mean() > 0.93 and got["score"].between(0, 1).all()


def test_language_edges(spark, awkward, empty):
    model = lang_id.train(table(spark, "documents"))
    got = {r["doc_id"]: r for r in lang_id.identify(awkward, model, with_spans=True).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[9]["lang_pred"] == "und" and got[2]["spans"] == []
    assert lang_id.identify(awkward, model).count() == len(AWKWARD) and lang_id.identify(empty, model).count() == 0
    none = lang_id.train(empty)
    assert none.languages == [] and {r["lang_pred"] for r in lang_id.identify(awkward, none).collect()} == {"und"}


def test_eighty_languages(spark):
    rng = random.Random(8)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(40)] for k in range(80)}
    data = [(i, " ".join(rng.choices(words[lang], k=30)), lang) for i, lang in enumerate(list(words) * 6)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = lang_id.identify_held_out(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95 and got["lang"].nunique() > 70
    with pytest.raises(ValueError, match="languages"):
        lang_id.train(df, max_languages=79)


def test_language_query_against_brute_force(spark):
    """The whole query again, word by word in plain Python, from the counts of all its training texts."""
    d = table(spark, "documents").select("doc_id", "text", "lang").collect()
    learn = [r for r in d if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    langs = sorted({r["lang"] for r in learn})
    words_of = lambda t: [m[0] for m in re.finditer(r"[^\W\d_]+", lang_id._lower(t))]
    counts = {x: [Counter(), Counter()] for x in langs}
    scripts = {x: Counter() for x in langs}
    script = lambda w: lang_id.NAMES[lang_id.SCRIPT[np.searchsorted(lang_id.FIRST, ord(w[0]), side="right") - 1]]

    def grams(w):
        g = lang_id.words_of(w).grams
        return g[0].tolist(), g[1].tolist()

    for r in learn:
        for w in words_of(r["text"].lower()):
            for c, g in zip(counts[r["lang"]], grams(w)):
                c.update(g)
            scripts[r["lang"]][script(w)] += len(w)
    total = {x: [sum(c.values()) + 0.5 * lang_id.BUCKETS for c in counts[x]] for x in langs}
    logs = {}
    for r in learn + d:
        for w in words_of(r["text"] or ""):
            if w not in logs:
                said = [sum(np.log((counts[x][k][g] + 0.5) / total[x][k]) for k in (0, 1) for g in grams(w)[k]) for x in langs]
                able = [scripts[x][script(w)] >= 0.01 * max(1, sum(scripts[x].values())) for x in langs]
                said = np.array(said) - max(said)
                logs[w] = np.where(able, said, lang_id.NEVER) if any(able) else np.zeros(len(langs))
    got = {r["doc_id"]: r for r in lang_id.identify_held_out(table(spark, "documents")).collect()}
    unlike = 0
    for r in d:
        words = words_of(r["text"] or "")
        v, back = np.zeros(len(langs)), []
        for w in words:
            stay = v >= v.max() - 8.0
            back.append(np.where(stay, np.arange(len(langs)), v.argmax()))
            v = np.maximum(v, v.max() - 8.0) + logs[w]
        weight, at = np.zeros(len(langs)), int(v.argmax())
        for w, b in zip(reversed(words), reversed(back)):
            weight[at] += len(w)
            at = b[at]
        have = got[r["doc_id"]]
        if not words:
            assert (have["lang_pred"], have["score"]) == ("und", 0.0)
        else:
            unlike += have["lang_pred"] != langs[weight.argmax()] or abs(have["score"] - weight.max() / weight.sum()) > 1e-9
    assert unlike <= 0.01 * len(d)  # near ties may go either way in single precision


def test_mixed_text_has_spans(spark):
    model = lang_id.train(table(spark, "documents"))
    text = "the this that with and of shthat nting " * 4 + "der einer nicht ungeheit schlich achkeit " * 4
    [r] = lang_id.identify(docs(spark, [(1, text)]), model, with_spans=True).collect()
    assert [s["lang"] for s in r["spans"]] == ["en", "de"] and text[r["spans"][1]["start"] :].startswith("der")


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.lists(st.integers(0, 200), min_size=1, max_size=5), st.integers(1, 5))
def test_blocked_viterbi_is_viterbi(seed, sizes, langs):
    rng = np.random.default_rng(seed)
    scores = (rng.random((sum(sizes), langs)) * -4).astype(np.float32)
    offsets = np.cumsum([0, *sizes])
    labels = lang_id.best_paths(scores, offsets, 2.0)

    def value(part, path):
        return sum(part[i, k] for i, k in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    for a, z in zip(offsets[:-1], offsets[1:]):
        part = scores[a:z].astype(float)
        v = np.zeros(langs)
        for s in part:
            v = np.maximum(v, v.max() - 2.0) + s
        if z > a:
            assert abs(value(part, labels[a:z].tolist()) - v.max()) < 1e-3


# 3 ------------------------------------------------------------------------------------------------


def ids_of(name, text):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path(name))
    return tok.encode(text or "", add_special_tokens=False).ids


def test_token_store_edges(spark, awkward, empty):
    got = token_store.read_token_store(token_store.write_token_store(awkward)).orderBy("start").collect()
    want, start = [], 0
    for i, text in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*ids_of("word_bpe_49k.json", text), 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    assert token_store.read_token_store(token_store.write_token_store(empty)).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "a<|endoftext|>b", "it's", "<|", "word ", "\n", "x<|endoftext|>", "Ünï"]), max_size=8))
def test_added_tokens_are_the_librarys(each):
    text = " ".join(each)
    for name, spaced in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)):
        assert WordCodec(P.path(name), spaced).encode([text])[0].tolist() == ids_of(name, text)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=50), max_size=8), st.integers(1, 40), st.sampled_from([1, 8]))
def test_shards_round_trip(each, block, bits):
    flat = np.array([i for x in each for i in x], np.uint32)
    s = token_store.Shard(token_store.pack_shard([None if k % 3 == 0 else -k for k in range(len(each))], flat, np.array([len(x) for x in each]), block, bits))
    assert (s.ids() == flat).all() and s.lengths.tolist() == [len(x) for x in each] and s.doc_ids == [None if k % 3 == 0 else -k for k in range(len(each))]
    if s.n_blocks:
        assert (s.read(s.n_blocks - 1) == flat[(s.n_blocks - 1) * block :]).all()
    with pytest.raises(ValueError):
        token_store.Shard(b"x" * 64)


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_codec_is_the_library(name, spaced, monkeypatch):
    from quillon.llm import wordcodec

    monkeypatch.setattr(wordcodec, "REMEMBERED", 300)  # memories age while it runs
    codec = WordCodec(P.path(name), spaced)
    random.seed(5)
    alphabet = ["a", "B", " ", "\n", "'", "s", ".", ",", "1", "é", "\t", "́", "漢", "|", "<|endoftext|>", "\x03", "word", " the", "ß"]
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 30))) for _ in range(1500)] + [t or "" for _, t in AWKWARD]
    for at in range(0, len(texts), 100):
        ids, off = codec.encode(texts[at : at + 100])
        for i, e in enumerate(codec.tok.encode_batch(texts[at : at + 100], add_special_tokens=False)):
            assert ids[off[i] : off[i + 1]].tolist() == e.ids


# 4 ------------------------------------------------------------------------------------------------


def brute_substrings(data):
    """doc_id, words, removed, digest, in order of rows."""
    starts = {}
    for i, text in data:
        w = WORDS.findall(text or "")
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                starts[key] = min(starts.get(key, i), i)
    out = []
    for i, text in data:
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and starts[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def check_substrings(spark, data, **how):
    got = [tuple(r) for r in substring_dedup.repeated_words(docs(spark, data)).collect()]
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1:])) == brute_substrings(data)


def test_substrings_of_generated_texts(spark, monkeypatch):
    random.seed(3)
    passages = [[f"p{k}_{i}" for i in range(n)] for k, n in enumerate((49, 50, 51, 80, 200))]
    data = []
    for i in range(60):
        words = []
        for _ in range(random.randint(0, 4)):
            p = random.choice(passages)
            words += [f"u{random.randint(0, 10**9)}" for _ in range(random.randint(0, 40))]
            words += p if random.random() < 0.6 else p[random.randint(0, 10) : random.randint(45, 120)]
        data.append((random.choice([i, i, i, 7, None]), random.choice([" ", "\n", " \t "]).join(words)))
    data += [(100, "echo " * 400), (101, "echo " * 60), (102, data[0][1]), (103, data[0][1])]
    check_substrings(spark, data)
    specs = substring_dedup.repeated_windows(docs(spark, data).select("doc_id", "text"), shard_phrases=5, part_words=300)  # many shards and parts
    whole = substring_dedup.repeated_windows(docs(spark, data).select("doc_id", "text"))
    def marks(df):
        return {(r[0], r[1]): [0] if not r[2] else sorted(x for a, z in np.frombuffer(r[2], "<i4").reshape(-1, 2).tolist() for x in range(a, z + 1)) for r in df.collect()}

    assert marks(specs) == marks(whole)


def test_substrings_edges(spark, empty):
    check_substrings(spark, AWKWARD)
    check_substrings(spark, [*AWKWARD, (11, LONG), (12, "x " + LONG)])
    assert substring_dedup.repeated_words(empty).count() == 0


def test_substrings_keep_other_texts(spark, awkward):
    out = substring_dedup.drop_repeated_words(awkward)
    assert out.columns == awkward.columns
    assert rows(out, "__spare").equals(rows(awkward, "__spare"))  # nothing repeats 50 words across ids


def test_locations_come_from_the_automata(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    data = [(1, "a " + passage), (2, "b " + passage + " c")]
    check_substrings(spark, data)
    text = substring_dedup.Text(1, 0, " ".join(f"q{i}" for i in range(300)).encode())
    phrases = [b" ".join(text.words[i : i + 8]) for i in np.flatnonzero(substring_dedup.chosen(text.h)[1])]
    assert len(text.locate(substring_dedup.automaton_of(phrases))) == 251
    assert len(text.locate(substring_dedup.automaton_of(phrases[:1]))) <= 43
    assert not len(text.locate(substring_dedup.automaton_of([b"no phrase of this text at all or anywhere"])))


def test_equal_hashes_of_unlike_windows(monkeypatch):
    monkeypatch.setattr(substring_dedup, "run_hashes", lambda sums, size: np.zeros(max(0, len(sums) - size), np.uint64))
    words = [[f"{k}_{i}" for i in range(60)] for k in (0, 1)] + [[f"0_{i}" for i in range(55)] + ["x"] * 5]
    texts = [substring_dedup.Text(k, k, " ".join(w).encode()) for k, w in enumerate(words)]
    text, start, own_text, own_start = substring_dedup.decide(texts, [np.arange(11) for _ in texts])
    assert sorted(zip(text.tolist(), start.tolist())) == [(2, i) for i in range(6)] and len(own_text) == 27


def test_many_copies_of_one_text(spark):
    """Copies of one text send it once; a hundred thousand of them are a row of numbers each."""
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.range(20_000).selectExpr("id as doc_id", f"'{text}' as text").unionByName(spark.range(50).selectExpr("id + 100000 as doc_id", f"concat('z', id, ' {text}') as text"))
    got = {r[0]: r[1] for r in substring_dedup.repeated_words(df).groupBy("n_removed").count().collect()}
    assert got == {0: 1, 300: 19_999 + 50}


def test_every_window_chooses_a_phrase():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    least, pick = substring_dedup.chosen(h)
    n = substring_dedup.WINDOW - substring_dedup.PHRASE + 1
    assert (least == [h[i : i + n].min() for i in range(len(least))]).all()
    assert (np.flatnonzero(pick) == sorted({i + int(h[i : i + n].argmin()) for i in range(len(least))})).all()


# 5 ------------------------------------------------------------------------------------------------


def brute_nearest(data, asks, k=5):
    good = {i: np.array(v, float) for i, v in data if v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in asks:
        if q in good:
            s = sorted(((-float(ann.cosines(good[q][None], v[None])[0]), i) for i, v in good.items() if i != q))[:k]
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return out


def test_nearest_edges(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=4).round(1).tolist()) for i in range(120)]
    data += [(200 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)] + [(300, None), (301, [0.0] * 4), (302, [1.0, None, 0.0, 0.0]), (303, [float("nan"), 1.0, 1.0, 1.0]), (304, [float("inf"), 1.0, 1.0, 1.0]), (305, []), (306, [1e300, 0.0, 0.0, 0.0]), (307, [-0.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asks = [0, 50, 200, 239, 300, 301, 306, 307]
    got = ann.nearest(df, df.where(df.vec_id.isin(asks))).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in got] == brute_nearest(data, asks)
    assert ann.nearest(df.where("vec_id < 3"), df.where("vec_id = 1")).count() == 2
    assert ann.nearest(df.where("false"), df).count() == 0


def test_nearest_ties_and_widths(spark):
    v = [0.3, -1.25, 0.5]
    data = [(i, [x * 2.0 ** (i % 13 - 6) for x in v]) for i in range(400, 100, -1)] + [(50, v)]
    data += [(1000 + i, [float(i + 1), 2.0]) for i in range(9)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id in (50, 1000)")).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got[:5]] == [101, 102, 103, 104, 105] and {r["score"] for r in got[:5]} == {got[0]["score"]}
    wide = [(i, w) for i, w in data if len(w) == 2]
    assert [tuple(r) for r in got[5:]] == brute_nearest(wide, [1000])
    many = spark.createDataFrame([(i, [1.0] * (i + 1)) for i in range(20)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="lengths"):
        ann.nearest(many, many)


def test_nearest_recall_on_the_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet") if os.path.exists("/root/testdata/sf0.1/embeddings.parquet") else table(spark, "embeddings")
    data = {r["vec_id"]: r["embedding"] for r in e.collect()}
    want = brute_nearest(list(data.items()), [i for i in data if i % 50 == 0])
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in ann.nearest(e, e.where("vec_id % 50 = 0")).collect()}
    hits = [(q, i) for q, _, i, _ in want if (q, i) in got]
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert all(abs(got[q, i] - s) < 1e-12 for q, _, i, s in want if (q, i) in got)


def test_nearest_recall_through_the_forest(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    data = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(4)
    asks = list(range(0, 6000, 100))
    monkeypatch.setattr(ann, "PART", 100)  # leaves are dealt out
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 100 = 0"), sample=3000).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    x = ann.unit(np.array([v for _, v in data]))
    s = x[asks] @ x.T
    s[np.arange(len(asks)), asks] = -9
    true = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(got[q] & set(t)) / 5 for q, t in zip(asks, true.tolist())]) >= 0.9


# 6 ------------------------------------------------------------------------------------------------


def test_bpe_round_trip(spark, awkward, empty):
    enc = byte_bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    coded = byte_bpe.bpe_encode(awkward)
    back = byte_bpe.bpe_decode(coded).collect()
    assert sorted(bytes(r["decoded"]) for r in back) == sorted((t or "").encode() for _, t in AWKWARD)
    assert {tuple(r["ids"]) for r in coded.collect()} == {tuple(enc.encode_ordinary(t or "")) for _, t in AWKWARD}
    want = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in AWKWARD)
    assert sorted(r["decoded_sha256"] for r in byte_bpe.bpe_digests(awkward).collect()) == want
    assert byte_bpe.bpe_digests(empty).count() == 0
    assert bytes(byte_bpe.bpe_decode(spark.createDataFrame([(1, [130, 131])], "doc_id long, ids array<int>")).first()["decoded"]) == enc.decode_bytes([130, 131])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB '.\n\t1é漢!s", max_size=120))
def test_safe_splits_change_nothing(text):
    enc = byte_bpe.encoding(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    parts = byte_bpe.split_safely(text, 5)
    assert "".join(parts) == text and [i for p in parts for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


# 7 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 5, 6, 7, 400, 390 * 6])
def test_stored_bytes_come_back(n, monkeypatch):
    payload = np.random.default_rng(n).integers(0, 256, 64 * n).astype(np.uint8).tobytes()
    data = jpeg.store(payload)
    assert jpeg.payload_of(jpeg.decode(data)) == payload
    if n < 10:
        monkeypatch.setattr(jpeg, "_fast", lambda *a: False)
        assert jpeg.payload_of(jpeg.decode(data)) == payload


@pytest.mark.parametrize(("w", "h", "grey"), [(16, 16, False), (33, 21, False), (70, 9, True)])
def test_decoder_agrees_with_another(spark, w, h, grey):
    """Progressive files written by Java's ImageIO, with its own scans and tables."""
    jvm = spark.sparkContext._jvm
    rng = np.random.default_rng(w)
    img = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    smooth = np.clip(128 + 60 * np.sin(np.arange(w)[None, :, None] / 5) + 40 * np.cos(np.arange(h)[:, None, None] / 4) + rng.normal(0, 6, (h, w, 3)), 0, 255).astype(int)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(v) for v in smooth[y, x])
            img.setRGB(x, y, r << 16 | g << 8 | b)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    param.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(img, None, None), param)
    stream.flush()
    data = bytes(out.toByteArray())
    assert b"\xff\xc2" in data
    theirs = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    if grey:  # getRGB would apply a gamma to grey samples
        want = np.array([[[theirs.getRaster().getSample(x, y, 0)] * 3 for x in range(w)] for y in range(h)])
    else:
        want = np.array([[[theirs.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(w)] for y in range(h)])
    mine = jpeg.rgb(jpeg.decode(data)).astype(int)
    assert mine.shape == (h, w, 3) and np.abs(mine - want).mean() < 4  # they smooth chroma when they upsample


def test_media_edges(spark, awkward, empty):
    stored = media.store_texts(awkward)
    got = {(r["doc_id"], r["payload_sha256"]): r for r in media.read_stored(stored).collect()}
    for i, t in AWKWARD:
        raw = media.padded(t or "")
        r = got[i, hashlib.sha256(raw).hexdigest()]
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len((t or "").encode()), len(raw), zlib.crc32(raw[-64:]))
    assert media.read_stored(media.store_texts(empty)).count() == 0
    broken = spark.createDataFrame([(1, b"junk"), (2, None), (3, jpeg.store(bytes(64))), (4, jpeg.store(bytes(64))[:150])], "doc_id long, media binary")
    out = {r["doc_id"]: (r["height"], r["error"] is None) for r in media.decode_images(broken).collect()}
    assert out[1] == (None, False) and out[2] == (None, True) and out[3] == (16, True) and out[4] == (None, False)


# 8 ------------------------------------------------------------------------------------------------


def plain_rounds(counts, capacity, ranges):
    """The rounds without Spark: ranges of sizes are swept by themselves, then all of them."""
    P = packing
    now, placed = [(P.PIECE, k, 0, v, 0, 0) for k, v in counts.items()] + [(P.NEXT, 0, 0, 1, 0, 0)], []
    while any(r[0] == P.PIECE for r in now):
        for whole in (False, True):
            now.sort(key=lambda r: (r[1], r[0], r[2]))
            parts = [[r for r in now if whole or r[1] * ranges // (capacity + 1) == k] for k in range(1 if whole else ranges)]
            now = [r for p in parts for r in P.sweep(p, capacity, whole)]
            placed += [r for r in now if r[0] == P.PLACED]
            now = [r for r in now if r[0] != P.PLACED]
    return placed


def check_places(placed, counts, capacity):
    """Every piece has one place, without gaps or overlaps; returns how many sequences there are."""
    filled, seen = {}, {k: [] for k in counts}
    for _, length, rank, n, first, offset in sorted(placed, key=lambda r: r[5]):
        seen[length] += range(rank, rank + n)
        for s in range(first, first + n):
            assert filled.get(s, 0) == offset
            filled[s] = offset + length
    assert all(sorted(v) == list(range(counts[k])) for k, v in seen.items()) and all(v <= capacity for v in filled.values())
    return len(filled)


def best_fit_decreasing(counts, capacity):
    """The number of sequences of best-fit decreasing, one by one."""
    rooms = []
    for length in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        at = bisect.bisect_left(rooms, length)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - length)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 60), max_size=12), st.integers(1, 6))
def test_rounds_fill_without_overlap(counts, ranges):
    n = check_places(plain_rounds(counts, 30, ranges), counts, 30)
    assert n <= best_fit_decreasing(counts, 30) + 2


@pytest.mark.parametrize("draw", [lambda g: g.lognormal(5.2, 1.2, 6000), lambda g: g.integers(1, 1025, 6000), lambda g: g.integers(2, 40, 6000), lambda g: g.integers(300, 500, 6000)])
def test_rounds_pack_as_best_fit_decreasing_does(spark, draw):
    lengths = np.clip(draw(np.random.default_rng(1)), 1, 1024).astype(int)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    df = spark.createDataFrame(list(counts.items()), "length long, n long")
    n = check_places([tuple(r) for r in packing.best_fit_rounds(df).collect()], counts, 1024)
    assert n <= best_fit_decreasing(counts, 1024) * 1.003 + 1


def test_packing_edges(spark, awkward, empty):
    got = packing.pack_texts(awkward, with_ids=True).toPandas()
    texts = sorted((tuple([*ids_of("byte_bpe_50k.json", t), 2]) for _, t in AWKWARD))
    parts = {}
    for (doc, digest), own in got.groupby([got["doc_id"].fillna(-1), got.index]):
        assert 1 <= own["length"].iloc[0] <= 1024 and zlib.crc32(np.array(own["ids"].iloc[0], "<u4").tobytes()) == own["ids_crc32"].iloc[0]
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert (seq["offset"].values == np.r_[0, seq["length"].cumsum().values[:-1]]).all() and seq["length"].sum() <= 1024
    for doc, own in got[got["doc_id"] == 7].sort_values("piece").groupby("doc_id"):
        assert tuple(np.concatenate(own["ids"].tolist()).tolist()) in texts and own["piece"].tolist() == list(range(len(own)))
        parts[doc] = len(own)
    assert parts[7] > 100 and got["sequence_id"].nunique() == -(-got["length"].sum() // 1024)
    assert packing.pack_texts(empty).count() == 0 and packing.pack(packing.token_pieces(empty)).count() == 0
    with pytest.raises(Exception, match="lengths must be"):
        packing.pack(spark.createDataFrame([(0,)], "length long")).count()
    with pytest.raises(ValueError, match="offset"):
        packing.pack(spark.createDataFrame([(1, 2)], "length long, offset long"))
    with pytest.raises(ValueError, match="no column length"):
        packing.pack(spark.createDataFrame([(1,)], "size long"))


def test_packing_carries_columns_of_any_name(spark):
    """Columns of the caller that are named as helper columns are, and pieces of which some were taken out."""
    lengths = [random.Random(3).randint(1, 40) for _ in range(300)]
    rows = [(n, 7, None, k, {"a b": k % 2}, 1, "x") for k, n in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "length int, part int, place long, base long, n map<string, int>, count int, `column 0` string").repartition(3)
    got = packing.pack(pieces, 40)
    assert got.columns == [*pieces.columns, "sequence_id", "offset"]
    packed = [r.asDict() for r in got.collect()]
    assert sorted((r["base"], r["length"], r["part"], r["place"], r["count"]) for r in packed) == [(k, n, 7, None, 1) for k, n in enumerate(lengths)]
    ends = {}
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 40
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert len(ends) <= best_fit_decreasing({n: lengths.count(n) for n in lengths}, 40) + 2
    some = packing.token_pieces(docs(spark, [(k, "a b c " * (k % 7)) for k in range(60)]), placed=True).where("piece = 0 and doc_id % 3 > 0")
    left = packing.pack(some, 1024).toPandas()
    assert len(left) == 40 and left.groupby("sequence_id")["length"].sum().sum() == left["length"].sum() and not left.duplicated(["sequence_id", "offset"]).any()


# 9 ------------------------------------------------------------------------------------------------


def toxic_table(spark, n=400):
    random.seed(9)
    data, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        s = [" ".join(f"w{random.randint(0, 300)}" for _ in range(8)) for _ in range(random.randint(1, 6))]
        if toxic:
            s[random.randrange(len(s))] += " " + random.choice(["slurking", "slurked", "vilen", "vilest"])
        data.append((i, ". ".join(s) + "."))
        labels.append((i, int(toxic)))
    return docs(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(data), dict(labels)


def test_toxicity_held_out_and_sentences(spark):
    d, labels, texts, truth = toxic_table(spark)
    got = toxicity.score_held_out(d, labels).toPandas()
    held = got[got["held_out"]]
    assert len(held) > 50 and (held["predicted"] == held["doc_id"].map(truth)).mean() > 0.95 and got["score"].between(0, 1).all()
    for r in got[got["predicted"] == 1].itertuples():
        assert all(re.search("slur|vile", texts[r.doc_id][s["start"] : s["end"]]) for s in r.offending)
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and {r[0] for r in kept.select("doc_id").collect()} == set(got[got["predicted"] == 0]["doc_id"])


def test_toxicity_edges(spark, awkward, empty):
    d, labels, *_ = toxic_table(spark, 100)
    model = toxicity.train(d, labels)
    assert toxicity.score(awkward, model).count() == len(AWKWARD) and toxicity.score(empty, model).count() == 0
    assert toxicity.score_held_out(awkward, labels.where("false")).where("predicted = 1").count() == 0
    nulls = spark.createDataFrame([(1, None), (None, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.score_held_out(awkward, nulls).count() == len(AWKWARD)


# 10 -----------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORDS.findall(text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root(i) != root(j):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def check_simhash(got, data):
    prints = [plain_fingerprint(t) for _, t in data]
    groups = brute_groups(prints)
    least = {g: min((i for (i, _), x in zip(data, groups) if x == g and i is not None), default=None) for g in groups}
    want = sorted(((i, f"{p:016x}", least[g]) for (i, _), p, g in zip(data, prints, groups)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_simhash_of_documents(spark):
    data = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    check_simhash(simhash.near_duplicates(table(spark, "documents")), data)


def test_simhash_edges(spark, awkward, empty):
    check_simhash(simhash.near_duplicates(awkward), AWKWARD)
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(1) == 1 and 5 not in ids and None in ids and len(ids) == len(set(ids))
    one_id = docs(spark, [(1, "some words of a text that stands alone"), (1, "quite another text under the same id here"), (2, "some words of a text that stands alone"), (2, "some words of a text that stands alone")])
    assert sorted(r["text"][:4] for r in simhash.drop_near_duplicates(one_id).collect()) == ["quit", "some"]


def test_every_pair_within_the_radius_meets():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 64, 200, dtype=np.uint64)
    for d in range(1, 6):
        flips = np.array([sum(1 << int(b) for b in rng.choice(64, d, replace=False)) for _ in base], np.uint64)
        for a, b in zip(base, base ^ flips):
            u, v = simhash.collisions(simhash.variants(np.array([a, b])))
            assert (len(u) > 0) == (d <= 3) and {*u, *v} <= {a, b}
    assert len(simhash.variants(base)) == sum(1056 if simhash.is_odd(x) else 65 for x in base)


@pytest.mark.parametrize(("seed", "block"), [(4, 300), (512, 2_000_000)])
def test_links_connect_what_brute_force_connects(spark, seed, block, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 12).astype(np.uint64)
    fps = set(base.tolist())
    for b in base.tolist():
        for _ in range(25):
            for bit in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                b ^= 1 << bit
            fps.add(b)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    comp = {r["node"]: r["component"] for r in components.connected_components(simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()}
    groups, mine = brute_groups(fps), [comp.get(s, s) for s in signed]
    pairs = lambda g: {(i, j) for i in range(len(g)) for j in range(i) if g[i] == g[j]}
    assert pairs(groups) == pairs(mine)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (500, 501)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {500 + i: 500 for i in range(1, 60)}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
