"""Operators of training data against brute force, and on odd tables."""

import hashlib
import random
import re
import tracemalloc
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import flac, idfiles, licenses, minhash, packing, pieces, pii, quality, simhash, warc

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, row string, label int"
LONG = "the quick brown fox, jumps over 1.2.3.4 " * 3000
ODD = [(1, None), (2, ""), (3, "one"), (4, "same text here"), (4, "same text here"), (None, "no id"), (7, LONG), (8, "a b\n\nc ▁ \x00 é漢🎉"), (9, "mail me@x.org or +1 (555) 123-4567, 4111 1111 1111 1111"), (10, "   "), (-5, "same text here")]


def table(spark, rows=ODD):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 1) for i, t in rows], SCHEMA)


LABELS = "doc_id bigint, quality int, toxic int"
CASES = {
    "op1": lambda s, d: minhash.fingerprint_edits(d),
    "op2": lambda s, d: licenses.scan(d),
    "op3": lambda s, d: pii.personal_data(d),
    "op4": lambda s, d: quality.score_documents(d, s.createDataFrame([(3, 1, 0), (7, 0, 0), (None, 1, 0), (8, None, 0), (4, 1, 0)], LABELS)),
    "op5": lambda s, d: pieces.encode_and_decode(d),
    "op6": lambda s, d: idfiles.id_file_round_trip(d),
    "op7": lambda s, d: simhash.near_duplicates(d),
    "op10": lambda s, d: flac.media_round_trip(d),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows_and_empty_tables(spark, name):
    got = CASES[name](spark, table(spark)).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(i) for i, _ in ODD)
    assert CASES[name](spark, table(spark, [])).count() == 0


def test_minhash(spark):
    rule = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    a = " ".join(rule.choices(words, k=400))
    b = " ".join(x if rule.random() > 0.01 else "zz" for x in a.split())
    rows = {r.doc_id: r for r in minhash.fingerprint_edits(table(spark, [(3, a), (2, b), (1, a)])).collect()}
    grams = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert abs(rows[3].near_next - true) < 0.12 and rows[1].fingerprint == rows[3].fingerprint
    edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
    assert rows[3].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert rows[1].near_next == 1.0  # after the smallest id comes the largest


def plain_minhash(text):
    """Nibbles of 256 bins by the definition; none for a text without words."""

    def chained(*raw):
        seed = 42
        for x in raw:
            seed = xxhash.xxh64_intdigest(x, seed)
        return seed - (1 << 64) if seed >> 63 else seed

    words = [w.encode() for w in re.split("[ \\t-\\r]+", text) if w]
    hashes = [chained(*words[i : i + 5]) for i in range(len(words) - 4)] or ([chained(*words)] if words else [])
    bins = [min((h for h in hashes if (h >> 56) + 128 == b), default=None) for b in range(256)]
    rule = random.Random(42)
    steps = [2 * rule.randrange(128) + 1 for _ in range(256)]
    starts = [rule.randrange(256) for _ in range(256)]
    out = []
    for j in range(256 if hashes else 0):
        filled = [bins[j]] + [bins[(steps[j] * t + starts[j]) % 256] for t in range(256)]
        value = next(v for v in filled if v is not None)
        out.append(chained(value.to_bytes(8, "little", signed=True), j.to_bytes(4, "little")) & 15)
    return out


def test_minhash_equals_the_definition(spark):
    rule = random.Random(14)
    words = [f"w{i}" for i in range(60)] + ["é", "漢字", "A"]
    texts = ["", "  \t\n", "one", "a b c d", "a b c d e"] + [" ".join(rule.choices(words, k=n)) for n in (6, 7, 9, 20, 60, 300, 900)]
    rows = minhash.fingerprint_edits(table(spark, list(enumerate(texts)))).collect()
    for r in rows:
        text, following = texts[r.doc_id], texts[r.doc_id - 1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        own, changed, other = map(plain_minhash, (text, edited, following))
        assert r.fingerprint == "".join(f"{x:x}" for x in own) and r.edited_fingerprint == "".join(f"{x:x}" for x in changed)

        def like(a, b):
            if not a or not b:
                return float(a == b)
            return max(0.0, (sum(x == y for x, y in zip(a, b)) / 256 - 1 / 16) / (1 - 1 / 16))

        assert abs(r.near_edited - like(own, changed)) < 1e-9 and abs(r.near_next - like(own, other)) < 1e-9


def test_minhash_next_documents(spark):
    rule = random.Random(9)
    rows = [(rule.choice([None, *range(-30, 30)]), "".join(rule.choices("ab cé", k=rule.randrange(0, 40)))) for _ in range(90)]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    stands = {}
    for i, t in rows:
        stands[i] = max(stands.get(i, ""), t, key=digest) if i in stands else t
    ids = sorted(stands, key=lambda i: (i is not None, i or 0), reverse=True)
    follow = {i: stands[ids[(k + 1) % len(ids)]] for k, i in enumerate(ids)}
    want = sorted((str(i), digest(t[: len(t) - len(t) // 2] + follow[i][: len(t) // 2])) for i, t in rows)
    assert sorted((str(r.doc_id), r.edited_sha256) for r in minhash.fingerprint_edits(table(spark, rows)).collect()) == want
    for alone in ([(None, "a b c")], [(5, "a b c")], [(5, "a b c"), (5, "a b c")]):
        assert {r.edited_sha256 for r in minhash.fingerprint_edits(table(spark, alone)).collect()} == {digest("a b" + "a ")}


def test_licenses(spark):
    mit = dict((k, v) for k, v in reversed(licenses.KNOWN))["MIT"]
    text = "Copyright (c) 2020 Someone\n\n" + licenses._MIT.upper().replace("SUBLICENSE", "sub-licence")
    rows = {r.doc_id: r for r in licenses.scan(table(spark, [(1, text), (2, "Hi.\nLicenced under CC BY-NC 4.0\nreleased under the mit license\nbye"), (3, "Copyright me")])).collect()}
    assert mit and rows[1].license == "MIT" and rows[2].license is None and rows[2].notices == "CC-BY-NC-4.0,MIT" and rows[3].license is None


def test_entire_licenses(spark):
    bsd = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n" + licenses._BSD_2 + licenses._BSD_NAME + licenses._BSD_END
    rows = {"Apache-2.0": 1, "GPL-3": 2, "GPL-2": 3, "LGPL-2.1": 4, "MPL-2.0": 5, "CC0-1.0": 6}
    texts = [(i, open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read()) for name, i in rows.items()]
    texts.append((7, texts[0][1].split("END OF TERMS")[0] + "END OF TERMS AND CONDITIONS\n"))
    got = {r.doc_id: r.license for r in licenses.scan(table(spark, [*texts, (8, bsd), (9, "BSD 3-Clause License\n\n" + bsd), (10, texts[1][1][:20000])])).collect()}
    assert got == {1: "Apache-2.0", 2: "GPL-3.0", 3: "GPL-2.0", 4: "LGPL-2.1", 5: "MPL-2.0", 6: "CC0-1.0", 7: "Apache-2.0", 8: "BSD-3-Clause", 9: "BSD-3-Clause", 10: None}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def test_license_sql_knows_the_same_texts(spark):
    texts = [t for _, t in licenses.entire_texts()] + [t for _, t in licenses.KNOWN]
    texts = sorted(set(texts)) + ["x\n" + texts[0], "MIT License\n\nCopyright (c) 2020 A\n\n" + licenses._MIT, "Released under the MIT License.\nmore", "", None]
    own = licenses.scan(table(spark, list(enumerate(texts)))).collect()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": texts}))
    want = con.sql(licenses.oracle_sql()).select("doc_id, digest, license, n_notices, notices").fetchall()
    assert sorted(tuple(r) for r in own) == sorted(want)
    assert len({r.license for r in own} - {None}) >= 30


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        own = []
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15):
                own.append(m.span())
        out.append(own)
    return out


def test_base_spans_equal_the_patterns():
    rule = random.Random(2)
    for _ in range(3000):
        text = "".join(rule.choice(["a", "@", ".", "_", "-", "+", "1", "23", " ", "(", ")", "x.y", "4111111111111111", "é", "%"]) for _ in range(rule.randrange(1, 25)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_revealing_terms(spark):
    near = "write to zyxwvut owner jo@x.org today"
    docs = table(spark, [(1, near), (2, near), *[(i, f"the owner of today is number{i} to write") for i in range(3, 60)]])
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    at = near.index("zyxwvut")
    assert rows[1].spans == f"email:{near.index('jo@')}:{near.index(' today')},term:{at}:{at + 7}" and rows[5].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert clean[1] == "write to  owner [EMAIL] today" and clean[5].startswith("the owner")


def test_revealing_terms_in_whole_documents(spark):
    far = "zyxwvut " + "the owner of today is to write " * 6 + "jo@x.org"
    docs = table(spark, [(1, "write to zyxwvut owner jo@x.org today"), (2, far), (3, "Zyxwvut alone"), *[(i, f"the owner of today is number{i} to write") for i in range(4, 60)]])
    rows = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    at = rows[1].spans.split(",")[1]
    assert at == "term:9:16" and rows[2].spans.endswith(",term:0:7") and rows[3].spans == "term:0:7" and rows[9].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert clean[1] == "write to [TERM] owner [EMAIL] today" and clean[2].startswith("[TERM] the owner") and clean[3] == "[TERM] alone" and clean[9].startswith("the owner")


def brute_terms(texts, reach, disclosure, support):
    """What each term tells of each entity, by the definition; and the spans of each text."""
    every, rows = {}, []
    for text in texts:
        spans = pii.base_spans(text)
        taken = [s for own in spans for s in own]
        words = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]{2,}", text) if not any(a < m.end() and m.start() < b for a, b in taken)]
        entities = {}
        for kind, own in zip(pii.KINDS, spans):
            for a, b in own:
                raw = text[a:b]
                entities.setdefault((kind, raw.lower() if kind == "email" else raw if kind == "ip" else re.sub("[^0-9]", "", raw)), []).append((a, b))
        rows.append((entities, words, {t for t, _, _ in words}))
        for e, at in entities.items():
            for t, a, b in words:
                if reach is None or any((x - reach <= a and b <= x) or (y <= a and b <= y + reach) for x, y in at):
                    every[e, t] = None
    told = {}
    for e, t in every:
        n_e, n_t, both = (sum(f(r) for r in rows) for f in (lambda r: e in r[0], lambda r: t in r[2], lambda r: e in r[0] and t in r[2]))
        p = n_e / len(texts)
        value = 0.0 if p >= 1 else 1 - np.log(both / n_t) / np.log(p)
        if both >= support and value >= disclosure - 1e-12:
            told[t] = max(told.get(t, 0), value)
    return told, [[(a, b, told[t]) for t, a, b in words if t in told] for _, words, _ in rows]


@pytest.mark.parametrize("reach", [None, 12, 100])
def test_revealing_terms_equal_brute_force(spark, reach):
    rule = random.Random(13)
    bits = ["jo@x.org", "JO@x.org", "10.0.0.7", "+1 (555) 123-4567", "Smithson", "smithson", "王五", "x99z", "4711", "the", "owner", "of", "a", "is", "ok", "_", "ünal"]
    texts = [" ".join(rule.choices(bits[:4] if rule.random() < 0.1 else bits[4:], k=1)[0] for _ in range(rule.randrange(1, 12))) for _ in range(150)]
    texts += ["filler words here"] * 60
    docs = table(spark, list(enumerate(texts)))
    _, want = brute_terms(texts, reach, 0.2, 2)
    got = {r.doc_id: r.spans for r in pii.personal_data(docs, disclosure=0.2, reach=reach).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitize(docs, disclosure=0.2, reach=reach).collect()}
    assert sum(map(len, want)) > 20
    for i, text in enumerate(texts):
        base = [f"{kind}:{a}:{b}" for kind, own in zip(pii.KINDS, pii.base_spans(text)) for a, b in own]
        assert got[i] == ",".join(base + [f"term:{a}:{b}" for a, b, _ in want[i]]), text
        assert clean[i] == pii.replaced(text, want[i])


def test_terms_are_generalised_by_class(spark):
    text = "id 王五 4711 x99z jo@x.org"
    docs = table(spark, [(1, text), (2, text), (3, "王五 4711 x99z"), *[(i, f"id of{i}") for i in range(4, 60)]])
    clean = {r.doc_id: r.text for r in pii.sanitize(docs).collect()}
    assert clean[3] == "[TERM] [NUMBER] [CODE]" and clean[1] == "id [TERM] [NUMBER] [CODE] [EMAIL]"


def test_sanitize_takes_any_columns(spark):
    docs = table(spark, [(1, "mail jo@x.org"), (2, None)])
    for name in ("__doc", "__hash", "__terms", "own", "id", "hash", "terms", "cleaned", "row"):
        got = pii.sanitize(docs.withColumn(name, F.lit("kept"))).collect()
        assert {(r.doc_id, r.text, r[name]) for r in got} == {(1, "mail [EMAIL]", "kept"), (2, None, "kept")}


def test_quality(spark):
    rule = random.Random(3)
    good = [(i, " ".join("".join(rule.choices("abcdefgh", k=rule.randrange(2, 9))) for _ in range(60)) + ".") for i in range(150)]
    bad = [(1000 + i, "BUY!! NOW!! $$$ ### " * rule.randrange(5, 30)) for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad], LABELS)
    rows = quality.score_documents(table(spark, good + bad), labels).collect()
    assert all(r.predicted == (r.doc_id < 1000) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    one = quality.score_documents(table(spark, good), labels.where("quality = 1")).collect()
    assert {r.score for r in one} == {1.0}


def plain_discriminant(x, y, new, pooled, identity):
    """Scores of ``new`` by the definition: shrunk covariances, densities by solving and determinants."""
    covs = [np.cov(x[y == k].T, ddof=0) for k in (0, 1)]
    share = [np.mean(y == k) for k in (0, 1)]
    common = share[0] * covs[0] + share[1] * covs[1]
    density = []
    for k in (0, 1):
        own = (1 - pooled) * covs[k] + pooled * common
        own = (1 - identity) * own + (identity * np.trace(own) / len(own) + 1e-6) * np.eye(len(own))
        d = new - x[y == k].mean(axis=0)
        density.append(-0.5 * (np.sum(d * np.linalg.solve(own, d.T).T, axis=1) + np.linalg.slogdet(own)[1]) + np.log(share[k]))
    return 1 / (1 + np.exp(density[0] - density[1]))


def test_quality_equals_the_definition(spark):
    rule = np.random.default_rng(21)
    y = rule.integers(0, 2, 400)
    x = rule.normal(size=(400, quality.N_FEATURES)) @ rule.normal(size=(quality.N_FEATURES, quality.N_FEATURES)) + y[:, None] * 0.7
    fold = rule.integers(1, quality.FOLDS, 400)
    rows = [(v.tolist(), int(k), int(f)) for v, k, f in zip(x, y, fold)]
    model = quality.fit(spark.createDataFrame(rows, "x array<double>, label int, fold int").repartition(3))

    def loss(choice):
        out = 0.0
        for f in range(1, quality.FOLDS):
            own, rest = fold == f, fold != f
            p = plain_discriminant(x[rest], y[rest], x[own], *choice)
            out -= np.log(np.where(y[own] == 1, p, 1 - p)).sum()
        return out

    best = min(quality.SHRINKAGE, key=loss)
    np.testing.assert_allclose(model.scores(x), plain_discriminant(x, y, x, *best), rtol=1e-6, atol=1e-9)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).where("held_out").join(labels.where("quality is not null"), "doc_id").collect()
    assert len(rows) > 50 and np.mean([r.predicted == r.quality for r in rows]) > 0.9


def brute_pieces(own, text, n):
    shown, out = text.replace(" ", pieces.SPACE), []

    def go(i, score, ids, lengths):
        if i == len(shown):
            out.append((-score, tuple(-x for x in reversed(lengths)), ids))
        for j in range(i + 1, min(len(shown), i + own.longest) + 1):
            p = own.piece.get(shown[i:j])
            if p is not None:
                go(j, score + own.plain_score[p], [*ids, p], [*lengths, j - i])
            elif j == i + 1:
                go(j, score + own.unknown, [*ids, *own.char_ids(text[i])], [*lengths, 1])

    go(0, 0.0, [], [])
    return [(-s, ids) for s, _, ids in sorted(out, key=lambda x: x[:2])[:n]]


def test_pieces_equal_brute_force():
    own, rule = pieces.lattice(), random.Random(4)
    words = [" the", "\n", "   ab", " 漢x", *["".join(rule.choices("aetinr é1.", k=rule.randrange(1, 9))).replace(" ", "") or "q" for _ in range(80)]]
    own.remember([words])
    for w in words:
        want, k = brute_pieces(own, w, 4), own.known[w]
        assert [(s, np.frombuffer(i, "<i4").tolist()) for s, i in own.search(w, 4)] == want
        assert np.frombuffer(own.ids[k], "<i4").tolist() == want[0][1] and own.best[k] == want[0][0]
        assert own.loss[k] == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)
    for text in ("a the", "of the on", "x  y\nzz", "trail", "no é 漢", *[" ".join("".join(rule.choices("aetinr", k=rule.randrange(1, 4))) for _ in range(3)) for _ in range(40)]):
        parts = own.words(text)
        own.remember([parts])
        found = own.n_best(parts, 4)
        want = brute_pieces(own, " " + text, 5)
        assert [s for s, _ in found] == [s for s, _ in want[:4]]
        if len({s for s, _ in want}) == len(want):  # no ties: the very segmentations
            assert [np.frombuffer(i, "<i4").tolist() for _, i in found] == [i for _, i in want[:4]]
        assert all(own.decode(np.frombuffer(i, "<i4")) == text for _, i in found)


def test_pieces_agree_with_the_model_on_most_words():
    import sentencepiece
    import public_tokenizers

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = pieces.lattice()
    table_ = pd.read_parquet(f"{SF}/documents.parquet", columns=["text"])
    words = sorted({w for t in table_["text"].dropna() for w in re.findall("[A-Za-z]+", t)})
    own.remember([[" " + w for w in words]])
    same = np.mean([np.frombuffer(own.ids[own.known[" " + w]], "<i4").tolist() == model.encode(w) for w in words])
    print("agreement", same, len(words))
    assert same > 0.7
    own.remember([[" trail"]])
    assert np.frombuffer(own.n_best([" trail"], 1)[0][1], "<i4").tolist() == model.encode("trail")


def test_pieces_of_a_long_word():
    own, rule = pieces.lattice(), random.Random(5)
    word = " " + "".join(rule.choices("abcdefgxyzABCXYZ0123456789+/", k=100_000))
    own.remember([[word]])
    tracemalloc.start()
    found = own.n_best([word], 4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20 and len({ids for _, ids in found}) == 4
    assert all(own.decode(np.frombuffer(ids, "<i4")) == word[1:] for _, ids in found)
    assert found[0][0] == own.best[own.known[word]] and [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_pieces_tables(spark):
    back = pieces.decode(pieces.encode(table(spark), n=2)).where("rank = 0")
    assert {(r.doc_id, r.text) for r in back.collect()} == {(i, (t or "").replace("▁", " ")) for i, t in ODD}


def test_id_files(spark):
    docs = table(spark)
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = idfiles.read_id_files(idfiles.write_id_files(docs)).collect()
    want = {(i, (x or "")): t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in ODD}
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == sorted((str(i), want[i, x or ""]) for i, x in ODD)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.cumsum([0, *[r.n_tokens for r in ordered][:-1]]).tolist()
    assert [r.doc_id for r in ordered][1:] == sorted(i for i, _ in ODD if i is not None)


def test_id_files_with_added_tokens(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one <|endoftext|> two", "in<|endoftext|>side", "a  <|endoftext|>  b\n <|endoftext|>", "<|endoftext|>", "none", "one two <|endoftext>"]
    rows = {r.doc_id: list(r.ids) for r in idfiles.read_id_files(idfiles.write_id_files(table(spark, list(enumerate(texts))))).collect()}
    assert rows == {i: t.encode(x, add_special_tokens=False).ids + [0] for i, x in enumerate(texts)} and 50256 in rows[1]


def plain_simhash(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r.doc_id: plain_simhash(r.text or "") for r in docs.collect()}
    assert all(rows[i].fingerprint == f"{fp:016x}" for i, fp in fps.items())
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert all(rows[i].component_id == find(i) for i in fps)


def test_simhash_hot_and_chained(spark):
    rule = random.Random(6)
    base = [rule.getrandbits(64) for _ in range(40)]
    values = {b ^ (1 << i) ^ (1 << j) for b in base for i in range(0, 64, 7) for j in range(0, 64, 5)} | set(base)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint")).collect()
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for e in edges:
        root[find(e.u)] = find(e.v)
    linked = {v: find(v) for v in signed}
    root = {v: v for v in signed}
    for a, b in combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
            root[find(a)] = find(b)
    true = {v: find(v) for v in signed}
    assert len(set(linked.values())) == len(set(true.values())) == len({(linked[v], true[v]) for v in signed})


def test_simhash_index_prunes_groups(spark):
    rule = random.Random(11)
    values = {rule.getrandbits(64) for _ in range(6000)}
    values |= {v ^ (1 << rule.randrange(64)) ^ (1 << rule.randrange(64)) for v in list(values)[:500]}
    signed = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp bigint").repartition(4)
    nodes = simhash.tree(signed, bucket=16, chunk=64).cache()
    for row in nodes.where("level = 0").collect():
        codes = np.array(row.members).view(np.uint64)
        want = ~(np.bitwise_and.reduce(codes) ^ np.bitwise_or.reduce(codes))
        assert (np.int64(row.mask).view(np.uint64), np.int64(row.pattern).view(np.uint64)) == (want, want & codes[0])
    sizes = {r.level: r["count"] for r in nodes.groupBy("level").count().collect()}
    assert sizes[3] == 1 and sizes[1] >= 100 and sizes[0] >= 400
    left = {level: simhash.descend(nodes, levels=3 - level).count() for level in (1, 0)}
    # most pairs of buckets go, and many go already with their chunks
    assert left[1] < 0.6 * sizes[1] * (sizes[1] + 1) / 2 and left[0] < 0.3 * sizes[0] * (sizes[0] + 1) / 2
    members = {r.id: r for r in nodes.where("level = 0").collect()}
    kept = {(r.l, r.r) for r in simhash.descend(nodes).collect()}
    at = {m: i for i, r in members.items() for m in r.members}
    for v in values:
        for i, j in combinations(range(-1, 64), 2):
            w = v ^ (1 << i if i >= 0 else 0) ^ (1 << j)
            if w in values:
                x, y = (at[c - (1 << 64) if c >> 63 else c] for c in (v, w))
                assert (x, y) in kept or (y, x) in kept
    rows = [simhash._Leaves(r.members, r.starts, r.masks, r.patterns) for r in members.values()]
    small = [simhash._Leaves(r.members, r.starts, r.masks, r.patterns) for r in simhash.tree(signed).where("level = 0").collect()]
    assert len(rows) > len(small)
    compared = sum(simhash.linked(a, b, a is b, 2)[2] for i, a in enumerate(small) for b in small[i:])
    leaves = sum(len(x.rows) for x in small)
    assert compared < 0.5 * leaves * (leaves + 1) / 2


def test_simhash_trees_of_any_shape_give_the_same_components(spark):
    rule = random.Random(12)
    base = [rule.getrandbits(64) for _ in range(3)]
    values = sorted({b ^ sum(1 << rule.randrange(64) for _ in range(rule.randrange(4))) & (1 << 64) - 1 for b in base for _ in range(400)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def classes(edges):
        root.update((v, v) for v in signed)
        for u, v in edges:
            root[find(u)] = find(v)
        groups = {}
        for v in signed:
            groups.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    true = classes((a, b) for a, b in combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2)
    table_ = spark.createDataFrame([(v,) for v in signed], "fp bigint").repartition(3)
    for bucket, chunk in ((4096, 1 << 20), (64, 300), (1, 7)):
        assert classes((e.u, e.v) for e in simhash.links(table_, bucket=bucket, chunk=chunk).collect()) == true, (bucket, chunk)


def test_keep_first_takes_any_columns(spark):
    docs = table(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (9, "x y z")])
    for name in ("__own", "id", "hash", "row", "unknown", "root"):
        got = simhash.keep_first(docs.withColumn(name, F.lit("kept")))
        assert {(r.doc_id, r[name]) for r in got.collect()} == {(5, "kept"), (9, "kept")} and got.count() == 2


def test_keep_first_keeps_one_of_each_component(spark):
    text, other = "one two three four five six", "seven eight nine ten eleven twelve"
    docs = table(spark, [(5, text), (5, other), (7, text), (7, text), (None, text), (None, "quite another text of words here"), (9, other)])
    assert sorted((str(r.doc_id), r.text) for r in simhash.keep_first(docs).collect()) == [("5", text), ("5", other), ("None", "quite another text of words here")]
    assert simhash.keep_first(table(spark, [(3, text), (3, text)])).count() == 1 and simhash.keep_first(table(spark, [])).count() == 0
    assert simhash.keep_first(docs).columns == docs.columns


def test_packing(spark):
    rule = random.Random(7)
    docs = table(spark, [(i, "x" * rule.choice([0, 3, 9, 50, 63, 64, 200])) for i in range(300)])
    rows = packing.pack(docs, capacities=(16, 32, 64)).collect()
    assert sorted((r.doc_id, r.piece) for r in rows) == sorted((i, p) for i, t in ((r.doc_id, len(r.text)) for r in docs.collect()) for p in range(t // 64 + 1))
    bins = {}
    for r in rows:
        bins.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_offset, r.length))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), own in bins.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity and capacity == min(c for c in (16, 32, 64) if c >= at)
    assert packing.pack(table(spark, [])).count() == 0


def test_packing_plan_equals_item_by_item():
    rule = random.Random(22)
    for _ in range(300):
        capacities = tuple(sorted(rule.sample(range(4, 80), rule.randrange(1, 4))))
        histogram = {n: rule.randrange(1, 12) for n in rule.sample(range(1, capacities[-1] + 1), rule.randrange(1, min(9, capacities[-1])))}
        left, bins, want = sum(n * k for n, k in histogram.items()), [], {}
        for length in sorted(histogram, reverse=True):
            for rank in range(histogram[length]):
                fits = [b for b in bins if b["space"] >= length]
                if not fits:
                    capacity = packing.cheapest(capacities, length, left)
                    bins.append({"capacity": capacity, "space": capacity, "number": len(bins)})
                    fits = bins[-1:]
                own = min(fits, key=lambda b: (b["space"], b["capacity"], b["number"]))
                want[length, rank] = (own["number"], own["capacity"] - own["space"])
                own["space"] -= length
                left -= length
        runs, groups = packing.plan(histogram, capacities)
        got = {}
        for r in runs:
            for i in range(r.count):
                got[r.length, r.first + i] = (r.bin_start + i // r.per_bin, r.offset + i % r.per_bin * r.length)
        assert got == want, (histogram, capacities)
        shrunk = {b["number"]: min(c for c in capacities if c >= b["capacity"] - b["space"]) for b in bins}
        assert shrunk == {g.start + i: g.capacity for g in groups for i in range(g.count)}


def test_packing_odd_rows(spark):
    rows = [*ODD, (None, "x" * 100), (None, "x" * 100), (7, "x" * 100)]
    got = packing.pack(table(spark, rows), capacities=(64, 128)).collect()
    assert sorted((str(r.doc_id), r.length) for r in got if r.piece == 0) == sorted((str(i), min(128, len((t or "").encode()) + 1)) for i, t in rows)
    assert sum(r.length for r in got) == sum(len((t or "").encode()) + 1 for _, t in rows)
    places = sorted((r.bin_id, r.bin_offset, r.length) for r in got)
    assert all(a != c or b + n <= d for (a, b, n), (c, d, _) in zip(places, places[1:]))


def test_warc(spark):
    html = "<p>é" * 600
    rows = [(1, "http://a", html), (5, "http://b", html), (3, None, "tiny"), (4, "x y\n", "tiny"), (6, "u", None), (7, "v", "z" * 300_000), (None, "w", html)]
    pages = spark.createDataFrame([(*r, "e") for r in rows], "page_id bigint, url string, html string, chunk_no string")
    got = {r.page_id: r for r in warc.archive_round_trip(pages).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("response", None), None: ("revisit", 5)}
    assert all(r.payload_digest == hashlib.sha1((dict((a, c) for a, _, c in rows)[i] or "").encode()).hexdigest() for i, r in got.items())
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_warc_odd_rows(spark):
    big = "<p>é漢" * 120_000
    rows = [(1, "u", big), (2, "u", big), (2, "u", big), (None, "n", None), (None, "n", big), (4, None, ""), (5, "x", "small"), (6, "x", "small"), (7, "e", "e" * 1000), (8, "e", "e" * 999), (9, "e", "e" * 999)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({c: F.lit("c") for c in ("same", "keep", "digest", "n_bytes", "chunk_no", "data")})
    got = sorted(((r.page_id is None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=str)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        best = max((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(data) >= 1000 and best is not None and i != best
        want.append((i is None, i or 0, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    assert got == sorted(want, key=str)
    with_data = warc.read_archives(warc.write_archives(pages), chunk=1000).where("page_id = 2 and record_type = 'response'").orderBy("chunk_no").collect()
    parts, number = {}, 0
    for r in with_data:
        parts.setdefault(r.chunk_no, []).append(bytes(r.data))
        assert len(r.data) <= 1000
    assert b"".join(own[0] for _, own in sorted(parts.items())) == big.encode() and all(len(own) == 2 for own in parts.values())


class PlainFlac:
    """A decoder of the format's description, a bit at a time, for mono streams."""

    def __init__(self, raw):
        assert raw[:4] == b"fLaC"
        self.points, last, at = [], False, 4
        while not last:
            last, kind, size = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
            body = raw[at + 4 : at + 4 + size]
            if kind == 0:
                self.total = int.from_bytes(body[13:18], "big") & (1 << 36) - 1
                assert body[10:14] and (int.from_bytes(body[10:18], "big") >> 41 & 7, int.from_bytes(body[10:18], "big") >> 36 & 31) == (0, 7)
            elif kind == 3:
                self.points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            at += 4 + size
        self.raw, self.first, self.bit = raw, at, at * 8

    def get(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | self.raw[self.bit >> 3] >> (7 - (self.bit & 7)) & 1
            self.bit += 1
        return out

    def signed(self, n):
        v = self.get(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def frame(self):
        assert self.get(16) == 0xFFF8
        code, _ = self.get(4), self.get(4)
        assert self.get(8) == 0x02
        lead = self.get(8)
        more = 0 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length() - 1
        self.get(8 * more)
        n = self.get(8) + 1 if code == 6 else self.get(16) + 1 if code == 7 else 192 if code == 1 else 576 << (code - 2) if code <= 5 else 256 << (code - 8)
        self.get(8)
        assert self.get(1) == 0
        kind = self.get(6)
        assert self.get(1) == 0
        if kind == 0:
            out = [self.signed(8)] * n
        elif kind == 1:
            out = [self.signed(8) for _ in range(n)]
        else:
            order = kind - 8 if kind < 32 else kind - 31
            out = [self.signed(8) for _ in range(order)]
            shift, weights = 0, ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))[order] if kind < 32 else ()
            if kind >= 32:
                precision, shift = self.get(4) + 1, self.signed(5)
                weights = [self.signed(precision) for _ in range(order)]
            method, parts = self.get(2), self.get(4)
            for p in range(1 << parts):
                k = self.get(4 + method)
                raw = self.get(5) if k == (15 if method == 0 else 31) else None
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    if raw is not None:
                        r = self.signed(raw)
                    else:
                        q = 0
                        while not self.get(1):
                            q += 1
                        v = q << k | self.get(k)
                        r = v >> 1 ^ -(v & 1)
                    out.append((sum(w * out[-1 - j] for j, w in enumerate(weights)) >> shift) + r)
        self.bit = (self.bit + 7) // 8 * 8 + 16
        return bytes(v + 128 for v in out)

    def all(self):
        out = b""
        while len(out) < self.total:
            out += self.frame()
        assert self.bit == 8 * len(self.raw)
        return out

    def seek(self, sample):
        start, offset, count = max(p for p in self.points if p[0] <= sample)
        self.bit = (self.first + offset) * 8
        block = self.frame()
        assert len(block) == count
        while sample >= start + len(block):  # a thinned table leads to a frame before
            start, block = start + len(block), self.frame()
        return block[sample - start]


def test_flac_by_a_plain_decoder():
    rule = np.random.default_rng(9)
    data = [b" " * 192, rule.bytes(960), "héllo wörld, the quick brown fox ".encode() * 40, (128 + 100 * np.sin(np.arange(4800) / 9)).astype(np.uint8).tobytes(), np.cumsum(rule.integers(-1, 2, 2880)).astype(np.uint8).tobytes(), bytes(range(256)) * 3, b"x"]
    for raw, stream in zip(data, flac.encode(data)):
        plain = PlainFlac(stream)
        assert plain.all() == raw
        for sample in {0, len(raw) // 2, len(raw) - 1}:
            assert plain.seek(sample) == raw[sample]


def test_flac_with_a_thinned_seek_table(monkeypatch):
    raw = np.random.default_rng(10).bytes(flac.BLOCK * 40)
    monkeypatch.setattr(flac, "SEEK_BYTES", 18 * 10)
    (stream,) = flac.encode([raw])
    plain = PlainFlac(stream)
    assert 1 < len(plain.points) <= 10 and plain.seek(20_000) == raw[20_000]
    blocks = list(flac.decode([stream]))
    assert b"".join(b[3] for b in blocks) == raw and [b[2] for b in blocks] == [i * flac.BLOCK for i in range(40)]


def test_flac_is_stored_and_read_back(spark):
    stored = flac.store_media(table(spark))
    assert stored.inputFiles() and sorted(map(str, (r.doc_id for r in stored.collect()))) == sorted(str(i) for i, _ in ODD)
    rows = {r.doc_id: r for r in flac.media_round_trip(table(spark)).collect()}
    for i, text in ODD:
        if i != 4:
            data = (text or "").encode()
            payload = data + b" " * (-len(data) % 192 if data else 192)
            offsets = np.arange(0, len(payload), flac.BLOCK)
            assert (rows[i].payload_sha256, rows[i].tail_crc32, rows[i].offsets_crc32) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), zlib.crc32(offsets.astype("<i8").tobytes()))


def test_flac_round_trip(spark):
    rule = np.random.default_rng(8)
    data = [b" " * 192, rule.bytes(1920), b"ab" * 672, "héllo wörld ".encode() * 150, (128 + 100 * np.sin(np.arange(19200) / 9)).astype(np.uint8).tobytes(), np.cumsum(rule.integers(-1, 2, 5760)).astype(np.uint8).tobytes(), b"x"]
    streams = flac.encode(data)
    out = [b""] * len(data)
    for s, _, offset, pcm in flac.decode(streams):
        assert offset == len(out[s])
        out[s] += pcm
    assert out == data and len(streams[4]) < len(data[4]) / 2
    for at in (len(streams[3]) // 2, len(streams[3]) - 1):
        broken = bytearray(streams[3])
        broken[at] ^= 4
        with pytest.raises(ValueError):
            list(flac.decode([bytes(broken)]))
    blocks = flac.to_pcm_blocks(flac.to_media(table(spark))).where("doc_id = 7").orderBy("block").collect()
    assert b"".join(b.pcm for b in blocks).rstrip(b" ") == LONG.encode().rstrip(b" ")
    assert [b.sample_offset for b in blocks] == [i * flac.BLOCK for i in range(len(blocks))]


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns, name
    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in quality.score_documents(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    good = docs.where(F.col("doc_id").isin([i for i, p in scores.items() if p]))
    firsts = {r.component_id for r in simhash.near_duplicates(good).collect()}
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == firsts
    for i, r in rows.items():
        assert r.n_chars == len(r.text) and not any(pii.base_spans(r.text))
        if not any(pii.base_spans(texts[i])):
            assert r.text == texts[i]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == firsts
    lengths = {}
    for r in packed:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert lengths == {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in rows.items()}


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_tables(spark, place):
    """Nulls, empty and very long texts, repeated rows, no rows, and columns with clashing names."""
    name, stage = corpus_pipeline.STAGES[place]
    rows = [*ODD, (None, "no id"), (7, LONG)]
    docs = table(spark, rows).withColumns({c: F.lit(c) for c in ("id", "hash", "own", "row", "x", "label", "terms", "total", "unknown", "bucket")})
    got = stage(spark, docs, SF)
    if place < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns and all(r.total == "total" and r.own == "own" for r in got.collect())
    ids = {r.doc_id for r in got.collect()}
    assert ids <= {i for i, _ in rows} and (name != "personal_data" or got.count() == len(rows)) and (name != "packing" or ids == {i for i, _ in rows})
    assert stage(spark, docs.limit(0), SF).count() == 0
