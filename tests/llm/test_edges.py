"""Edge cases: repeated rows and keys, nulls, long texts, hostile values, clashing columns; parts against independent versions."""

import hashlib
import itertools
import math
import random
import time
from collections import Counter

import numpy as np
import pytest


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


# --- Hashing ------------------------------------------------------------------------------


def test_word_and_window_hashes_do_not_depend_on_pieces(monkeypatch):
    from provena.llm import words

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.choice((1, 2, 7, 300)))) for _ in range(60)).encode() for _ in range(5)] + [b"", b" \n", b"x" * 1000]
    want = words.doc_words(texts, True)
    wide = words.window_hash(want[0], 5)
    monkeypatch.setattr(words, "PIECE", 64)
    got = words.doc_words(texts, True)
    assert all((a == b).all() for a, b in zip(want, got, strict=True))
    assert (words.window_hash(got[0], 5) == wide).all()
    distinct = {bytes(w) for t in texts for w in t.lower().split()}
    assert len(set(got[0].tolist())) == len(distinct)


def test_long_texts_keep_hash_tables_small():
    from provena.llm import words

    words._TABLES.clear()
    words.window_hash(words.doc_words([b"ab " * 1_500_000 + b"z" * 2_000_000])[0], 20)
    assert all(len(t) <= 1 << 18 for pair in words._TABLES.values() for t in pair)


# --- 4 and 5: repeated keys -----------------------------------------------------------------


A, B = (" ".join(f"{c}{i}" for i in range(58)) for c in "ab")


def test_near_duplicates_of_one_key_with_different_texts(spark):
    from provena.llm.minhash_dedup import near_duplicates

    rows = [(5, A), (5, B), (7, A + " x"), (9, B + " y"), (5, A), (3, "alone here now"), (None, A)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (3, 3, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


def test_near_duplicates_under_text_keys_and_with_marks(spark):
    from provena.llm.minhash_dedup import near_duplicates

    docs = spark.createDataFrame([("k2", A, 1), ("k1", A + " x", 2), ("k3", B, 3)], "doc_id string, text string, row int")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in near_duplicates(docs, marks=True).collect()}
    assert got == {"k1": ("k1", True), "k2": ("k1", False), "k3": ("k3", True)}
    assert near_duplicates(docs, marks=True).columns == ["doc_id", "n_shingles", "component_id", "kept", "mark"]


def test_exact_dedup_of_one_key_with_different_texts(spark):
    from provena.llm.exact_dedup import exact_dedup

    head = "h" * 100
    rows = [(5, head + "A"), (5, head + "B"), (7, head + " A"), (9, head + "B")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(5, 5, 2, True), (5, 7, 2, False), (7, 7, 2, True), (9, 5, 2, False)]


def test_stages_drop_rows_and_not_keys(spark):
    import corpus_pipeline

    rows = [(5, A, 1, "x"), (5, B, 2, "x"), (3, B + " ", 3, "x"), (None, A, 4, "x"), (6, A, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark int, __spot string")
    kept = sorted(r["mark"] for r in corpus_pipeline.drop_exact_copies(spark, docs, "").collect())
    assert kept == [1, 3, 4]
    again = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert again.columns == docs.columns and sorted(r["mark"] for r in again.collect()) == [1, 3, 4]


# --- 2: decontamination -----------------------------------------------------------------------


def test_decontaminate_is_the_same_over_one_and_many_automata(spark):
    from provena.llm import decontaminate as d

    rng = random.Random(8)
    long = " ".join(f"q{rng.randrange(50)}" for _ in range(5000))
    items = [(1, "a short item"), (2, long), (None, "nobody owns this passage of exactly ten words you see"), (3, None), (4, "a short item")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = ["it is a SHORT item!", " ".join(long.split()[2040:2060]), "so nobody owns this passage of exactly ten words you see", None, "", "clean words only", "it is a SHORT item!"]
    rows = [(7, t, "x") for t in texts] + [(None, texts[0], "y"), (None, texts[5], "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items string")
    seen = []
    for limit in (1 << 20, 2000):
        found = d.digest(d.decontaminate(docs, bench, max_pattern_chars=limit)).collect()
        assert len(found) == len(rows)
        seen.append((sorted(map(repr, found)), sorted(map(repr, d.clean(docs, bench, max_pattern_chars=limit).collect()))))
    assert seen[0] == seen[1]
    hits = Counter((r["n_words"], r["n_hit"], r["n_items"]) for r in found)
    assert hits == {(5, 3, 2): 3, (20, 20, 1): 1, (11, 10, 0): 1, (0, 0, 0): 2, (3, 0, 0): 2}
    assert sorted(r["text"] or "" for r in d.clean(docs, bench).collect()) == ["", "", "clean words only", "clean words only"]


def test_pieces_of_items_hold_every_window_once():
    import pyarrow as pa

    from provena.llm import decontaminate as d

    for n in (0, 1, 9, 10, 11, d.PIECE_WINDOWS + 9, d.PIECE_WINDOWS + 10, 3 * d.PIECE_WINDOWS):
        words = [f"w{i}" for i in range(n)]
        batch = pa.RecordBatch.from_pydict({"item": ["x"], "text": [" ".join(words)]})
        got = [w for out in d._pieces(10)([batch]) for t in out.column(1).to_pylist() for p in [t.split()] for w in (tuple(p[i : i + 10]) for i in range(max(1, len(p) - 9)) if p)]
        assert sorted(got) == sorted(tuple(words[i : i + 10]) for i in range(max(1, n - 9)) if words)


# --- 9: byte-level BPE --------------------------------------------------------------------------


def merge_pairs(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges by their definition: the pair of least rank first, leftmost first."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, math.inf), i) for i, (a, b) in enumerate(itertools.pairwise(parts)))
        if best[0] == math.inf:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def test_byte_bpe_by_definition_and_under_any_key(spark):
    import public_tokenizers
    import regex

    from provena.llm import byte_bpe as b

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks, vocab = b.load_ranks(path), b.vocabulary(spark, path, public_tokenizers.PATTERN)
    texts = ["Größe matters, doesn't it?  12345 \n\n  x", "naïve 日本語 🙂🙂 code_like(x)->y;", "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "", None, "Größe matters, doesn't it?  12345 \n\n  x", " \u0000 tab\tend"]
    rows = list(zip([3, 4, 5, None, 6, 3, None], texts, strict=True))
    docs = spark.createDataFrame(rows, "doc_id smallint, text string")
    want = Counter()
    for i, t in rows:
        ids = [x for w in regex.findall(public_tokenizers.PATTERN, t or "") for x in merge_pairs(w.encode(), ranks)]
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(t or ""))] += 1
    encoded = b.encode(docs, vocab, words_per_bin=3)
    assert Counter(tuple(r) for r in b.digest(encoded, vocab).collect()) == want
    assert Counter(tuple(r) for r in b.encode(docs, vocab, digests=True).collect()) == want


# --- 1 and 7: classifiers --------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["!" * 200_000 + "a", "! " * 100_000, "a!" * 100_000, "!!" * 100_000 + " "])
def test_quality_features_are_linear(text):
    from provena.llm.quality import features

    features("warm up !!")
    began = time.process_time()
    features(text)
    assert time.process_time() - began < 2


def test_quality_counts_runs_of_signs_at_the_end_of_tokens():
    from provena.llm import quality

    assert quality._EDGE.findall("a!! b?!x !!! c! .. d... (e)..") == ["!!", "!!!", "..", "...", ").."]


def test_bradley_terry_weights_are_a_minimum_of_the_pairwise_loss():
    from provena.llm import quality

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, quality.N_FEATURES))
    y = (x[:, 0] + 0.5 * rng.normal(size=40) > 0).astype(int)
    model = quality.fit(x, y)
    design = model.design(x)

    def loss(w):
        s = [sum(w[j] for j in row) for row in design]
        return sum(math.log1p(math.exp(-(s[a] - s[b]))) for a in range(40) if y[a] for b in range(40) if not y[b]) / (y.sum() * (1 - y).sum()) + 0.5e-5 * (w @ w)

    best = loss(model.weights)
    assert best < 0.05 < loss(np.zeros_like(model.weights))
    assert all(loss(model.weights + 0.3 * rng.normal(size=len(model.weights))) > best for _ in range(10))


def test_decoding_finds_the_cheapest_of_all_spellings():
    """Viterbi against every path through the lattice, by the model's own costs."""
    from provena.llm import toxicity as t

    model = t.CharModel(t.trigram_counts(Counter({"idiot": 40, "you": 60, "all": 30, "the": 90, "good": 30})))

    def options(raw, i):
        c, before = raw[i], raw[i - 1] if i else ""
        drop = t.COST["drop"] if c * 3 in raw[max(0, i - 2) : i + 3] else t.COST["double"]
        if c in t.SEPARATORS and 0 < i < len(raw) - 1 and (c not in t.SIGNS or raw[i - 1].isalpha() or raw[i - 1] in t.SIGNS):
            return [("", t.COST["join"]), (" ", t.COST["split"])] + [(x, t.COST["sign"]) for x in t.SIGNS.get(c, "")]
        if c in t.SIGNS:
            return [(x, t.COST["sign"]) for x in t.SIGNS[c]] + [(" ", t.COST["keep"])] + ([("", drop)] if before == c else [])
        return [("", drop), (c, t.COST["repeat"])] if before == c else [(c, 0.0)]

    def cost(emits):
        total, a, b, last = 0.0, 0, 0, ""
        for emit, extra in emits:
            total += extra
            if emit == " ":
                total += model.cost[a, b, 0] if last and last != " " else 0.0
                a = b = 0
            elif emit:
                s = t.symbol(emit)
                total += model.cost[a, b, s]
                a, b = b, s
            last = emit or last
        return total + model.cost[a, b, 0]

    for raw in ("1d10t", "1 d 1 0 t", "y0uu", "g00d", "th3 @11", "!d!0t", "4ll", "y.o.u", "ggg00d", "i_d_1_o_t"):
        paths = [tuple(p) for p in itertools.product(*[options(raw, i) for i in range(len(raw))])]
        least = min(map(cost, paths))
        spelled = {"".join(e for e, _ in p).strip() for p in paths if cost(p) <= least + 1e-9}
        assert t.decode(raw, model) in spelled, raw


def test_classifiers_score_repeated_rows_alike(spark):
    from provena.llm import quality, toxicity

    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "you idiot!! | |"), (2, "other")]
    docs = spark.createDataFrame([(i, t, 9.0) for i, t in rows], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (2, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(docs, module.train(docs, labels)).collect()
        assert len(got) == 5 and len({r["score"] for r in got if r["doc_id"] in (1, None)}) == 1


# --- 10: WARC ----------------------------------------------------------------------------------------


def test_warc_hostile_urls_repeated_rows_and_large_payloads(spark, tmp_path):
    from provena.llm import warc

    evil = "http://h/a\r\nWARC-Type: revisit\r\n\r\nx y\t é%20"
    big = "".join(random.Random(4).choice("abcdefgh") for _ in range(300_000))
    rows = [(1, evil, "<p>1</p>", "n"), (1, evil, "<p>1</p>", "n"), (2, "", big, "n"), (3, None, "<p>1</p>", "n"), (4, "u", "\r\n\r\n", "n"), (-5, "u", None, "n"), (None, "v", "<p>1</p>", "n")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, shard string")
    path = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages, path, shard_bytes=1000, max_file_bytes=500).collect()
    assert len({r["shard"] for r in manifest}) > 1
    got = warc.read_warc(spark, path, with_payload=True).collect()
    assert len(got) == len(rows)
    one = [r for r in got if r["page_id"] == 1]
    assert {r["record_type"] for r in one} == {"revisit"} and {r["refers_to"] for r in one} == {3}
    assert one[0]["url"] == "http://h/a%0D%0AWARC-Type:%20revisit%0D%0A%0D%0Ax%20y%09%E2%80%A8é%20"
    by = {r["page_id"]: r for r in got}
    assert bytes(by[2]["payload"]).decode() == big and bytes(by[4]["payload"]) == b"\r\n\r\n" and by[-5]["payload_bytes"] == 0


def test_warc_reader_rejects_damage(spark, tmp_path):
    from provena.llm import warc

    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame([(i, "u", f"<p>{i}</p>") for i in range(9)], "page_id bigint, url string, html string"), path)
    file = next((tmp_path / "w").glob("*.gz"))
    file.write_bytes(file.read_bytes()[:-9])
    with pytest.raises(Exception, match="differs from its manifest|ends inside a record"):
        warc.read_warc(spark, path).collect()


def test_shard_bounds_are_exact(spark):
    from provena.llm.warc import shard_bounds

    rng = random.Random(1)
    ids = sorted({rng.choice((rng.randrange(100), rng.randrange(10**15), -rng.randrange(10**6))) for _ in range(600)})
    rows = [(i, rng.randrange(1, 400)) for i in ids for _ in range(rng.choice((1, 1, 3)))]
    before, want, held = 0, {}, Counter()
    for i, n in rows:
        held[i] += n
    for i in ids:
        want.setdefault(before // 5000, i)
        before += held[i]
    for parts in (1, 7):
        assert shard_bounds(spark.createDataFrame(rows, "_id bigint, _bytes bigint").repartition(parts), 5000) == sorted(want.values())


# --- 6: the lexer ---------------------------------------------------------------------------------------


SECRET = "Zx9!kQ2#mL7p"


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ('client_credential = ("Zx9!kQ" + "2#mL7p")', ["Zx9!kQ", "2#mL7p"]),
        ('client_credential = ("Zx9!kQ"\n    b"2#mL7p")\n', ["Zx9!kQ", "2#mL7p"]),
        ("$client_credential = 'Zx9!kQ' . '2#mL7p';", ["Zx9!kQ", "2#mL7p"]),
        ('client_credential = "Zx9!kQ" \\\n  + "2#mL7p"', ["Zx9!kQ", "2#mL7p"]),
        (r'accesskey := "Zx9\"kQ2\\mL7p"', [r"Zx9\"kQ2\\mL7p"]),
        ('conf["private_key"] = r"Zx9!kQ2#mL7p"', [SECRET]),
        ('<add key="DbCredential" value="Zx9!kQ2#mL7p"/>', [SECRET]),
        ("- name: DB_CREDENTIAL\n  value: Zx9!kQ2-mL7p\n", ["Zx9!kQ2-mL7p"]),
        ('# old_pwd = "Zx9!kQ2#mL7p"', [SECRET]),
        ('KEY_A = "Zx9!kQ2#mL7p"\nlog.info("x")\nKEY_B = KEY_A\nsvc.accesskey = KEY_B', [SECRET]),
        ('# KEY_A = "Zx9!kQ2#mL7p"\naccesskey = KEY_A', []),  # a comment defines nothing
        ('url = "http://h/#a"  # pwd below\nZ = "Zx9!kQ2#mL7p"\npwd = Z', [SECRET]),
        ('pwd = "Zx9!kQ2#mL7p', []),
        ("it's a key: don't say 'token' here, it isn't one", []),
        ('pwd = getpass("Zx9!kQ2#mL7p")', []),
    ],
)
def test_secret_lexer(text, parts):
    from provena.llm import secret_scan as s

    got = [text[a:b] for _, a, b, _, _ in sorted(s.lexed_spans(text), key=lambda x: x[1])]
    assert got == parts


def test_secret_scan_of_repeated_rows_and_null_keys(spark):
    from provena.llm import secret_scan as s

    docs = spark.createDataFrame([(i, f'pwd = "{SECRET}"', 1) for i in (3, 3, None)] + [(4, None, 1)], "doc_id bigint, text string, found int")
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in s.digest(s.find_secrets(docs)).collect()) == [(0, "literal:7:19"), (3, "literal:7:19"), (3, "literal:7:19"), (4, "")]


@pytest.mark.parametrize("text", ["'" * 200_000, 'pwd = ("' + "a" * 200_000, 'pwd = "a" + ' * 30_000, "pwd = (" * 40_000, 'pwd="\\' * 60_000, "name: a\n" * 60_000, 'key="a" ' * 50_000, "pwd = " + '"a"\n + ' * 50_000])
def test_secret_lexer_is_linear(text):
    from provena.llm import secret_scan

    began = time.process_time()
    secret_scan.scan_text(text)
    assert time.process_time() - began < 10
