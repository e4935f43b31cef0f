"""Tagger and parsers against brute force over all taggings and trees."""

import random
import re
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lexiloom.operators import analysis, charts, hmm
from lexiloom.operators.hmm import TAGS
from lexiloom.plans.catalogue import QUERIES

WORDS = ["the", "Dog", "dogs", "chased", "running", "of", "cats", "quickly", "42", ".", "xyzzy", "and"]


def small_model(rule, symbols=4):
    one = lambda *shape: rule.dirichlet(np.ones(shape[-1]), size=shape[:-1])
    return hmm.Model(list(hmm.SHAPES)[:symbols], one(len(TAGS)), one(len(TAGS), len(TAGS)), one(len(TAGS), symbols))


def every_path(model, obs):
    """Probability of each sequence of tags, by the definition."""
    for path in product(range(len(TAGS)), repeat=len(obs)):
        p = model.start[path[0]] * model.emit[path[0], obs[0]]
        for a, b, x in zip(path, path[1:], obs[1:]):
            p *= model.after[a, b] * model.emit[b, x]
        yield path, p


def test_expected_counts_equal_brute_force():
    rule = np.random.default_rng(1)
    model = small_model(rule)
    lines = [rule.integers(0, 4, n) for n in (1, 3, 2, 3, 0)]
    counts = hmm.Counts(model)
    counts.add(np.concatenate(lines), np.array([len(x) for x in lines]))
    start, after, emit, likelihood = np.zeros(15), np.zeros((15, 15)), np.zeros((4, 15)), 0.0
    for obs in lines:
        if not len(obs):
            continue
        paths = list(every_path(model, obs))
        total = sum(p for _, p in paths)
        likelihood += np.log(total)
        for path, p in paths:
            start[path[0]] += p / total
            for t, x in zip(path, obs):
                emit[x, t] += p / total
            for a, b in zip(path, path[1:]):
                after[a, b] += p / total
    for got, want in ((counts.start, start), (counts.after, after), (counts.emit, emit), (counts.likelihood, likelihood)):
        assert np.allclose(got, want)


def test_likeliest_tags_equal_brute_force():
    rule = np.random.default_rng(2)
    model = hmm.first_model([("the", 5), ("of", 3), ("dogs", 2)])
    model = hmm.Model(model.symbols, rule.dirichlet(np.ones(15)), rule.dirichlet(np.ones(15), size=15), model.emit)
    lines = [[model.symbol(w) for w in rule.choice(WORDS, n)] for n in (1, 2, 3, 3, 3)]
    got = hmm.decode(model, np.concatenate(lines), np.array([len(x) for x in lines]))
    at = 0
    for obs in lines:
        best = max(p for _, p in every_path(model, obs))
        own = tuple(got[at : at + len(obs)])
        assert np.isclose(dict(every_path(model, obs))[own], best) and best > 0
        at += len(obs)


def sentences(spark, rule, n):
    rows = [([rule.choice(WORDS) for _ in range(rule.randrange(0, 9))],) for _ in range(n)]
    return spark.createDataFrame(rows + [(None,)], "tokens array<string>").repartition(4)


def test_likelihood_rises_and_equals_one_machine(spark):
    rows = sentences(spark, random.Random(3), 200)
    model, likelihoods = hmm.fit(rows, rounds=6, most=5)
    assert all(b >= a - 1e-6 for a, b in zip(likelihoods, likelihoods[1:])) and likelihoods[-1] > likelihoods[0] + 1
    own = hmm.first_model(hmm.words_of(rows, 5))
    lines = [r.tokens for r in rows.collect() if r.tokens]
    for _ in range(6):
        counts = hmm.Counts(own)
        counts.add(np.array([own.symbol(w) for x in lines for w in x]), np.array([len(x) for x in lines]))
        own = hmm.updated(own, counts.start, counts.after, counts.emit.T)
    assert own.symbols == model.symbols and np.allclose(own.after, model.after) and np.allclose(own.emit, model.emit)
    assert hmm.fit(rows.limit(0), rounds=2)[1] == [0.0, 0.0]


def test_every_token_has_a_symbol_and_tags():
    model = hmm.first_model([])
    for word in WORDS + ["Über-Straße", "l’eau", "½", "٣٤", "漢字", "É", "ﬁ", "ǅ", "_", "🎉", "Ⅻ", "²"]:
        assert hmm.tags_of(model.symbols[model.symbol(word)])


def every_tree(i, j, g, symbol, tags):
    """Weights of all trees of a span, by the definition."""
    if j - i == 1:
        w = g.lexical[tags[i], symbol]
        if w > -np.inf:
            yield w
        return
    for a, b, c, w in zip(g.whole, g.left, g.right, g.weight):
        if a == symbol:
            for k in range(i + 1, j):
                for x in every_tree(i, k, g, b, tags):
                    for y in every_tree(k, j, g, c, tags):
                        yield w + x + y


def weight_of(tree, g, tags):
    if isinstance(tree[1], int):
        return g.lexical[tags[tree[1]], charts.SYMBOLS.index(tree[0])]
    left, right = tree[1:]
    at = [charts.SYMBOLS.index(x[0]) for x in (tree, left, right)]
    own = [w for a, b, c, w in zip(g.whole, g.left, g.right, g.weight) if [a, b, c] == at]
    return own[0] + weight_of(left, g, tags) + weight_of(right, g, tags)


def leaves(tree):
    return [tree[1]] if isinstance(tree[1], int) else leaves(tree[1]) + leaves(tree[2])


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_constituents_equal_brute_force(n):
    rule, g = np.random.default_rng(n), charts.grammar()
    tags = rule.integers(0, len(TAGS), (60, n))
    none = 0

    def best(row, i, j):
        return max((w for s in range(len(charts.SYMBOLS)) for w in every_tree(i, j, g, s, row)), default=-np.inf)

    def cover(row, ends):
        return sum(best(row, i, j) + charts.PART for i, j in zip((0, *ends), (*ends, n)))

    for row, (weight, tree) in zip(tags, charts.constituents(tags)):
        want = max((g.roots[s] + w for s in range(len(charts.SYMBOLS)) if g.roots[s] > -np.inf for w in every_tree(0, n, g, s, row)), default=-np.inf)
        if tree[0] == charts.FRAGMENT:
            none += 1
            covers = [cover(row, ends) for k in range(n) for ends in combinations(range(1, n), k)]
            own = sum(weight_of(part, g, row) + charts.PART for part in tree[1:])
            assert want == -np.inf and np.isclose(weight, max(covers)) and np.isclose(weight, own)
            assert [x for part in tree[1:] for x in leaves(part)] == list(range(n))
            continue
        assert np.isclose(weight, want)
        assert leaves(tree) == list(range(n)) and np.isclose(weight_of(tree, g, row) + g.roots[charts.SYMBOLS.index(tree[0])], weight)
    assert 0 < none < 60


def test_brackets():
    at = [TAGS.index(t) for t in ("DT", "JJ", "NN", "VBD", "IN", "NNS", ".")]
    words = ["the", "old", "dog", "slept", "on", "rugs", "."]
    (_, tree), = charts.constituents(np.array([at]))
    assert charts.bracketed(tree, words, [TAGS[t] for t in at]) == "(S (S (NP (DT the) (JJ old) (NN dog)) (VP (VBD slept) (PP (IN on) (NP (NNS rugs))))) (. .))"
    at = [TAGS.index(t) for t in ("CC", "DT", "NN", "DT")]
    (_, tree), = charts.constituents(np.array([at]))
    assert charts.bracketed(tree, ["and", "a", "dog", "the"], ["CC", "DT", "NN", "DT"]) == "(FRAG (CC and) (NP (DT a) (NN dog)) (DT the))"


def projective(heads):
    def over(i):
        out = [i]
        while heads[out[-1]] >= 0:
            if heads[out[-1]] in out:
                return None
            out.append(heads[out[-1]])
        return out

    paths = [over(i) for i in range(len(heads))]
    if sum(h < 0 for h in heads) != 1 or None in paths:
        return False
    return all(h in paths[k] for i, h in enumerate(heads) if h >= 0 for k in range(min(i, h) + 1, max(i, h)))


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_dependencies_equal_brute_force(n):
    rule = np.random.default_rng(n)
    weights, root = rule.normal(size=(25, n, n)), rule.normal(size=(25, n))
    trees = [h for h in product(range(-1, n), repeat=n) if all(i != x for i, x in enumerate(h)) and projective(h)]
    heads, best = charts.dependencies(weights, root)
    value = lambda row, h: sum(root[row, i] if x < 0 else weights[row, x, i] for i, x in enumerate(h))
    for row in range(25):
        assert projective(heads[row].tolist()) and np.isclose(value(row, heads[row].tolist()), best[row])
        assert np.isclose(best[row], max(value(row, h) for h in trees))


def test_analyses(spark):
    rule = random.Random(6)
    texts = ["\n".join(" ".join(rule.choice(WORDS) for _ in range(rule.randrange(1, 12))) for _ in range(4)) for _ in range(40)]
    odd = [None, "", " \n\t\n", "word " * 700 + ".", "... !!! ???", "one\r\ntwo\rthree", "　", "the dog chased cats . And more"]
    kinds = ["POS", "CONSTITUENCY", "DEPENDENCY", "NEW", None]
    rows = [(i, kinds[i % 5], t) for i, t in enumerate(texts)] + [(100 + 10 * i + k, kind, t) for i, t in enumerate(odd) for k, kind in enumerate(kinds)] + [(None, "POS", "a b"), (1, "POS", "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, analysis string, text string")
    analyser = analysis.fit(docs, rounds=2, most=8)
    got = analysis.analyze(docs, analyser).collect()
    assert len(got) == len(rows)
    for r in got:
        (own,) = {t or "" for i, _, t in rows if i == r.doc_id} if r.doc_id != 1 else {"a b"} if r.output.startswith("INPUT: a b\n") else {texts[1]}
        lines = [x for x in own.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip(" \t\n　")]
        assert [b.split("\nOUTPUT: ")[0] for b in r.output.split("\n\n") if b] == [f"INPUT: {x}" for x in lines]
    by = {r.doc_id: r.output for r in got}
    assert by[130].count("word (") == 700 and by[131].count(" word)") == 700 and by[132].count("word-") == 2 * 700 + 17 and by[132].count("root(ROOT-0") == 1
    assert by[133].endswith("OUTPUT: Unknown analysis type: NEW\n\n") and by[100] == by[111] == ""
    assert "more" not in by[171].split("OUTPUT: ")[1] and by[172].split("OUTPUT: ")[1].count("root(ROOT-0") == 1
    words = analysis.tagged(docs, analyser)
    tokens = docs.select(F.explode(hmm.tokens_of(F.coalesce("text", F.lit("")))).alias("w"))
    assert words.agg(F.sum("n")).first()[0] == tokens.count() and {r.tag for r in words.where("word = 'the'").collect()} == {"DT"}
    empty = docs.limit(0)
    assert analysis.analyze(empty, analysis.fit(empty, rounds=1)).count() == 0


def test_queries_analyse_whole_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    tokens = docs.select(F.explode(hmm.tokens_of(F.coalesce("text", F.lit("")))).alias("w"))
    words = QUERIES["tagged_words"](spark, "/root/testdata/sf0.001").groupBy("word").agg(F.sum("n").alias("n")).collect()
    assert {r.word: r.n for r in words} == {r.w: r["count"] for r in tokens.groupBy("w").count().collect()}
    parsed = QUERIES["parsed_dependencies"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in parsed) == sorted(texts)
    for r in parsed:
        blocks = [b.split("\nOUTPUT: ") for b in r.output.split("\n\n") if b]
        assert [b[0].removeprefix("INPUT: ") for b in blocks] == [x for x in re.split("\r\n|\r|\n", texts[r.doc_id]) if x.strip()]
        assert all(b[1] == "" or b[1].count("root(ROOT-0, ") == 1 for b in blocks)


def test_memory_follows_slices_not_batches():
    """A batch is worked on in slices of AT_ONCE tokens, and a document larger than that alone."""
    sizes = [0, 3, analysis.AT_ONCE + 5, 0, *[analysis.AT_ONCE // 4] * 9]
    tokens = pa.array([[["a"] * n] if n else [] for n in sizes], pa.list_(pa.list_(pa.string())))
    batch = pa.RecordBatch.from_arrays([tokens, pa.array(range(len(sizes)))], names=["tokens", "doc_id"])
    parts = list(analysis._slices([batch, batch.slice(0, 0)]))
    assert [x for p in parts for x in p.column("doc_id").to_pylist()] == list(range(len(sizes)))
    for p in parts:
        assert len(p) == 1 or pc.sum(pc.list_value_length(p.column("tokens").flatten())).as_py() <= analysis.AT_ONCE
    assert len(parts) == 5


def test_alike_tags_are_parsed_once(monkeypatch):
    rows = []
    chart = charts.constituents
    monkeypatch.setattr(charts, "constituents", lambda tags: rows.append(len(tags)) or chart(tags))
    own = np.array([TAGS.index(t) for t in ("DT", "NN", "VBD")])
    found = analysis.constituency([(i, ["the", f"w{i}", "ran"], own) for i in range(1000)])
    assert sum(rows) == 1 and found[7] == "(ROOT (S (NP (DT the) (NN w7)) (VP (VBD ran))))"


def test_every_sentence_of_a_line_is_parsed(spark):
    """Not only a line's first one: each has an output of its own, in their order."""
    text = "The dog chased cats . And more ! quickly running ?\nno stop\n \n. !"
    rows = [(k, kind, text) for k, kind in enumerate(("CONSTITUENCY", "DEPENDENCY"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, analysis string, text string")
    got = {r.doc_id: r.output for r in analysis.analyze(docs, analysis.fit(docs, rounds=1, most=8)).collect()}
    want = [["The dog chased cats .", "And more !", "quickly running ?"], ["no stop"], [".", "!"]]
    for k, words in ((0, r" ([^ ()]+)\)"), (1, r", (\S+)-\d+\)")):
        blocks = [b.split("\nOUTPUT: ") for b in got[k].removesuffix("\n\n").split("\n\n")]
        assert [[" ".join(re.findall(words, parse)) for parse in b[1:]] for b in blocks] == want
        assert all(parse.count("(ROOT " if k == 0 else "root(ROOT-0, ") == 1 for b in blocks for parse in b[1:])


def test_tokens_of_texts_equal_those_of_spark(spark):
    rule = random.Random(8)
    letters = ["a", "É", "ß", "'", "’", "-", "1", "٣", "½", ".", ",", " ", "\t", " ", " ", "́", "漢", "🎉", "𝔘", "_", "\x0b", "\x1c", "\x85", "﻿", "!"]
    texts = ["".join(rule.choice(letters[: rule.choice((17, 25))]) for _ in range(rule.randrange(30))) for _ in range(400)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", hmm.tokens_of(F.col("text")).alias("tokens")).collect()
    for r in rows:
        assert hmm.tokens_and_ends(r.text) == r.tokens
    assert hmm.tokens_and_ends("a\r\nb\rc\n") == ["a", "\r", "\n", "b", "\r", "c", "\n"]


def test_work_of_a_round_follows_distinct_runs():
    """Expected counts of runs are those of lines; alike runs of a task are one, however many lines there are."""
    rule = random.Random(9)
    texts = ["\n".join(" ".join(rule.choice(WORDS) for _ in range(rule.randrange(0, 60))) for _ in range(6)) for _ in range(30)] + [None, ""]
    model = hmm.first_model([("the", 5), ("dogs", 3), ("running", 2), (".", 9)])
    model = hmm.Model(model.symbols, np.random.default_rng(3).dirichlet(np.ones(15)), np.random.default_rng(4).dirichlet(np.ones(15), size=15), model.emit)

    def distinct(times):
        return pa.Table.from_batches(list(hmm._alike(iter([pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})] * times), model)))

    one, many = distinct(1), distinct(20)
    assert len(one) == len(many) and pc.sum(many["n"]).as_py() == 20 * pc.sum(one["n"]).as_py()
    own, plain = hmm.Counts(model), hmm.Counts(model)
    own.add_runs(hmm.Runs(model.emit > 0), many["run"].combine_chunks(), many["n"].to_numpy())
    lines = [x.split() for t in texts if t for x in t.split("\n")]
    for _ in range(20):
        plain.add(np.array([model.symbol(w) for x in lines for w in x]), np.array([len(x) for x in lines]))
    for name in ("start", "after", "emit", "likelihood"):
        assert np.allclose(getattr(own, name), getattr(plain, name))


def best_tree(row, g):
    """The tree of the docstrings' order by exact tenths: most weight, first split, first rule."""
    tenths = lambda x: None if x == -np.inf else round(x * 10)
    rules = [(int(a), int(b), int(c), tenths(w)) for a, b, c, w in zip(g.whole, g.left, g.right, g.weight)]
    cells = {}
    for length in range(1, len(row) + 1):
        for i in range(len(row) - length + 1):
            j = i + length
            for s in range(len(charts.SYMBOLS)):
                if length == 1:
                    if (w := tenths(g.lexical[row[i], s])) is not None:
                        cells[i, j, s] = (w, (charts.SYMBOLS[s], i))
                    continue
                own = [(cells[i, k, b][0] + cells[k, j, c][0] + w, -k, -at) for k in range(i + 1, j) for at, (a, b, c, w) in enumerate(rules) if a == s and (i, k, b) in cells and (k, j, c) in cells]
                if own:
                    w, k, at = max(own)
                    cells[i, j, s] = (w, (charts.SYMBOLS[s], cells[i, -k, rules[-at][1]][1], cells[-k, j, rules[-at][2]][1]))
    n = len(row)
    whole = [(cells[0, n, s][0] + tenths(g.roots[s]), -s) for s in range(len(charts.SYMBOLS)) if (0, n, s) in cells and tenths(g.roots[s]) is not None]
    if whole:
        return cells[0, n, -max(whole)[1]][1]
    top = lambda i, j: max(((cells[i, j, s][0], -s) for s in range(len(charts.SYMBOLS)) if (i, j, s) in cells), default=None)
    reached = {0: (0, ())}
    for j in range(1, n + 1):
        w, i = max((reached[i][0] + top(i, j)[0] + round(10 * charts.PART), -i) for i in range(j) if top(i, j))
        reached[j] = (w, (*reached[-i][1], cells[-i, j, -top(-i, j)[1]][1]))
    return (charts.FRAGMENT, *reached[n][1])


def test_equal_weights_follow_the_order_of_splits_and_rules():
    """Tenths add up exactly: rounding decides between no two trees."""
    rule, g = np.random.default_rng(11), charts.grammar()
    tags = rule.choice([TAGS.index(t) for t in ("NN", "NN", ".", ".", "JJ", "VB", "RB", "VB", "IN", "CC")], (12, 18))
    for row, (_, tree) in zip(tags.tolist(), charts.constituents(tags)):
        assert tree == best_tree(row, g)


def test_alike_tags_have_dependencies_found_once(monkeypatch):
    """Also over calls that share forms; words and places of pieces of a long sentence are its own."""
    rows, chart = [], charts.dependencies
    monkeypatch.setattr(charts, "dependencies", lambda weights, root: rows.append(len(weights)) or chart(weights, root))
    analyser = analysis.Analyser(None, np.zeros((4, len(TAGS), len(TAGS))))
    own = np.array([TAGS.index(t) for t in ("DT", "NN", "VBD")])
    known = {}
    for call in range(3):
        found = analysis.dependency([(i, ["the", f"w{call}%{i}", "ran"], own) for i in range(1000)], analyser, known)
        assert found[7] == f"det(w{call}%7-2, the-1)\nnsubj(ran-3, w{call}%7-2)\nroot(ROOT-0, ran-3)"
    assert sum(rows) == 1
    (long,) = analysis.dependency([(0, [f"w{i}" for i in range(99)], np.resize(own, 99))], analyser, known).values()
    assert re.findall(r", w(\d+)-(\d+)\)", long) == [(str(i), str(i + 1)) for i in range(99)] and long.count("root(ROOT-0, ") == 1 and long.count("parataxis(") == 2
    assert analysis.dependency([(0, [], own[:0]), (1, ["a"], own[:1])], analyser) == {1: "root(ROOT-0, a-1)"}


def test_rounding_decides_between_no_two_dependency_trees():
    rule = np.random.default_rng(5)
    told = rule.choice([0.1, 0.2, 0.3, 0.7], (4, len(TAGS), len(TAGS)))
    tags = rule.choice([TAGS.index(t) for t in ("NN", "NN", ".", "JJ", "VB")], (300, 14))
    sentences = [(i, [str(k) for k in range(14)], t) for i, t in enumerate(tags)]
    near = told * (1 + 1e-13 * rule.normal(size=told.shape))
    assert analysis.dependency(sentences, analysis.Analyser(None, told)) == analysis.dependency(sentences, analysis.Analyser(None, near))
