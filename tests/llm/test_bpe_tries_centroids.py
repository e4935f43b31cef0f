"""Byte-level BPE, conversation tries and centroid clusters against brute force, and on odd tables."""

import base64
import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F

from lexiloom.llm import bpe, centroids, common, tries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def own_ranks():
    with open(RANKS, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def plain_bpe(text, ranks):
    """Merge the pair of least rank, the first of equal ones, in each match of the pattern."""
    out = []
    for match in regex.findall(public_tokenizers.PATTERN, text):
        parts = [bytes([b]) for b in match.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 40), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out += [ranks[p] for p in parts]
    return out


ALPHABET = ["a", "b", "don't", "'s", "'", "''", " ", "  ", "\n", "\t", "\r\n", "1", "23", "é", "漢", "字", "。", "，", "カ", "한", ".", "--", "!'", "_", " ", " ", "　", "\x1c", "​", "🎉", "́", "½", "٣", "ǅ"]


def test_cut_texts_have_the_ids_of_whole_ones():
    ranks, rule = own_ranks(), random.Random(5)
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = bpe.Codec(RANKS, chunk=1, run=2)
    cuts = 0
    for n in range(3000):
        text = "".join(rule.choices(ALPHABET, k=rule.randrange(0, 40)))
        ids = list(struct.unpack(f"<{len(cut.encode(text)) // 4}I", cut.encode(text)))
        assert ids == whole.encode_ordinary(text)
        assert "".join(part for part, _ in cut.parts(text)) == text
        assert cut.decode(cut.encode(text)) == text.encode()
        cuts += len(list(cut.parts(text))) - 1
        if n < 200:
            assert ids == plain_bpe(text, ranks)
    assert cuts > 5000


def test_long_white_space_and_special_strings():
    codec = bpe.codec()
    for text in (" " * 1_000_000, "x" + "\n " * 600_000 + "y", "a" * 300_000, "漢" * 100_000, "word " * 60_000, "<|endoftext|> " * 6000):
        assert codec.decode(codec.encode(text)) == text.encode()
    short = bpe.Codec(RANKS, chunk=10, run=50)
    for text in ("x" + " " * 3000 + "y", "x" + " " * 3000, " " * 2999 + "\ny", "\n" * 900 + "1", "ab\t" + "　" * 700 + "é <|endoftext|>"):
        assert short.encode(text) == codec.encode(text)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, ids string, n_tokens string")


ODD = [(1, None), (2, ""), (3, "one"), (4, "same"), (4, "same"), (None, "no id"), (7, "the quick 1.2, fox\n" * 20_000), (8, "é漢🎉\x00 ▁"), (-5, "   ")]


def test_bpe_rows(spark):
    got = bpe.round_trip(docs(spark, ODD)).collect()
    ranks = own_ranks()
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in ODD:
        ids = whole.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.round_trip(docs(spark, [])).count() == 0
    own = bpe.encode(docs(spark, [(1, "a b")])).select(bpe.ids_of(F.col("ids")).alias("ids")).first()
    assert own.ids == whole.encode_ordinary("a b")


def plain_trie(sequences):
    """Rows of the trie of conv_id -> list of (role, text), by the definition."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[x] for x in children[node])
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else -1, len(m), len(children[n]), leaves[n], saved[n], digest(ends[n])) for n, m in members.items())


def rebuilt(rows):
    """Conversations of (conv_id, turn, role, text), rebuilt by the definition."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return own, out


def shown(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, d bigint, size string").repartition(5)


def some_rows(rule, n):
    rows = []
    for c in range(-n // 3, n):
        opening = rule.choice(["hi", "hi", "hi", "é🎉", "", None])
        for t in range(rule.choice([0, 1, 2, 3, 5, 9, 12])):
            rows.append((c, t if t or rule.random() < 0.7 else None, rule.choice(["user", "user", None]), opening if t == 0 else rule.choice(["a", "b", "cc", None])))
    return rows + [(None, 0, "user", "hi")]


@pytest.mark.parametrize("shard", [6, 40, 1 << 14])
def test_tries_equal_brute_force(spark, many_ranges, shard):
    rows = some_rows(random.Random(shard), 60)
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(0, 200, 5) for t in range(4)]  # exact copies
    rows += [(2000, t, "user", f"long {t % 3}") for t in range(300)]
    own, mixed = rebuilt(rows)
    assert shown(tries.mixed_trie(conversations(spark, rows), shard)) == plain_trie(mixed)
    assert shown(tries.prefix_trie(conversations(spark, rows), shard)) == plain_trie(own)


def test_tries_of_odd_tables(spark):
    assert tries.mixed_trie(conversations(spark, [])).count() == 0
    assert tries.mixed_trie(conversations(spark, [(None, 1, "user", "x")])).count() == 0
    rows = [(4, None, None, None), (4, 0, "user", "x" * 100_000), (4, 0, "user", "x" * 100_000), (5, 1, "", "")]
    own, mixed = rebuilt(rows)
    assert shown(tries.mixed_trie(conversations(spark, rows))) == plain_trie(mixed)
    assert shown(tries.prefix_trie(conversations(spark, rows), 1)) == plain_trie(own)


def test_louds():
    parent = np.array([3, -1, 1, 1, 3, -1, 5])
    label = np.array([9, 1, 7, 5, 8, 2, 0])
    order, trie = tries.level_order(parent, label)
    assert order.tolist() == [1, 5, 3, 2, 6, 4, 0] and trie.labels.tolist() == [1, 2, 5, 7, 0, 8, 9]
    assert "".join(map(str, np.unpackbits(trie.bits, count=trie.size))) == "110" + "110" + "10" + "110" + "0" * 4
    assert trie.parents().tolist() == [-1, -1, 0, 0, 1, 2, 2] and trie.levels() == [(0, 2), (2, 5), (5, 7)]
    assert trie.rolled_up(np.ones(7))[0].tolist() == [5, 2, 3, 1, 1, 1, 1]


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, v string, cluster int").repartition(3)


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    means = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(means))[::-1]
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[near(v)[0]].append(v)
        for j, own in groups.items():
            means[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, j, d in found:
        inertia[j] += d
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted((repr(i), j, d, inertia[j], sum(inertia.values()), digest(means[j])) for i, j, d in found)


def test_clusters_equal_brute_force(spark):
    rule = np.random.default_rng(3)
    rows = [(i, (rule.normal(size=64) * 0.2 + rule.integers(0, 3)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, [float(x)] * 64) for i, x in enumerate(rule.integers(-2, 3, 60) / 1024, 500)]  # ties
    rows += [(7, rows[3][1]), (None, rows[4][1]), (900, [0.0] * 63), (901, [0.0] * 63 + [None]), (902, [0.0] * 63 + [float("nan")]), (903, [float("-inf")] * 64), (904, None), (905, [])]
    got = sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clusters(embeddings(spark, rows)).collect())
    assert got == plain_clusters(rows)
    wide = [(i, (rule.normal(size=64) * 5000).astype(np.float32).tolist()) for i in range(30)]
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clusters(embeddings(spark, wide)).collect()) == plain_clusters(wide)
    few = [(1, [0.5] * 64), (2, [-0.5] * 64), (2, [-0.5] * 64)]
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroids.clusters(embeddings(spark, few)).collect()) == plain_clusters(few)
    assert centroids.clusters(embeddings(spark, [])).count() == 0 and centroids.clusters(embeddings(spark, [(None, [1.0] * 64)])).count() == 0


def test_sort_means_stops_early_and_breaks_ties():
    rule = np.random.default_rng(4)
    means = rule.integers(-3, 4, (40, 4)) * 100
    means[7] = means[3]
    vectors = means[rule.integers(0, 40, 3000)] + rule.integers(-60, 61, (3000, 4))
    every = ((vectors[:, None] - means[None]) ** 2).sum(axis=2)
    for before in (rule.integers(0, 40, 3000), np.argmin(every, axis=1), np.zeros(3000, np.int64)):
        nearest, least, taken = centroids.assign(vectors, before, means)
        assert (nearest == np.argmin(every, axis=1)).all() and (least == every.min(axis=1)).all()
    taken = centroids.assign(vectors, np.argmin(every, axis=1), means)[2]
    assert taken < 3000 * 40 / 4  # most centroids are too far from the old one to be looked at


def test_flags_hold_all_rows_and_few_others(spark):
    rows = spark.range(0, 20_000, 1, 4).select(F.concat(F.lit("w"), F.col("id")).alias("t"))
    bits = common.flag_bits(rows, F.xxhash64("t"))
    hashes = [xxhash.xxh64_intdigest(f"w{i}", 42) for i in range(220_000)]
    assert all(common.passes(bits, h) for h in hashes[:20_000])
    assert sum(common.passes(bits, h) for h in hashes[20_000:]) < 200_000 / 1000
    assert common.all_passing(bits, np.array(hashes, np.uint64).view(np.int64)).tolist() == [common.passes(bits, h) for h in hashes]
    assert not any(map(lambda h: common.passes(common.flag_bits(rows.limit(0), F.xxhash64("t")), h), hashes[:3]))
