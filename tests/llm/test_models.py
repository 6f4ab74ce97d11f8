"""Classifiers, language, chat and the pipeline: held-out accuracy, brute-force versions and odd inputs."""

import collections
import itertools
import random
import zlib

import numpy as np
import pytest
from brute import FOLD, components, words

import corpus_pipeline
from gristmill.llm import graph, op4_quality, op5_toxicity, op7_language, op10_chat
from gristmill.llm.labelled import calibration

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, score string"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, None, None, 0, 5, "x"), (2, "", "en", "s", 0, 5, "x"), (3, " \n\t", "en", None, 1, 5, "x"), (3, " \n\t", "en", None, 1, 5, "x"), (4, "word " * 30_000, None, "s", 1, 5, "x"), (5, "12 34 !!", "fr", "s", 1, 5, "x"), (None, "the cat", "en", "s", 1, 5, "x"), (6, "日本語 текст", None, "s", 1, 5, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def remainder(i, n):
    return zlib.crc32(str(i).encode()) % n


def auc(score, label):
    order = np.argsort(np.argsort(score))
    pos = label == 1
    return (order[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_quality(documents, labels):
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = op4_quality.quality(documents, labels).collect()
    assert len(got) == documents.count()
    for r in got:
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    held = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert auc(*map(np.array, zip(*held, strict=True))) > 0.95


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert auc(op4_quality.Additive().fit(x[:3000], y[:3000]).score(x[3000:]), y[3000:]) > 0.97


def test_toxicity(spark):
    documents, labels = spark.read.parquet(f"{LARGER}/documents.parquet"), spark.read.parquet(f"{LARGER}/labels.parquet")
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = op5_toxicity.toxicity(documents, labels).collect()
    assert len(got) == documents.count()
    for r in got:
        assert r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    score, label, said = map(np.array, zip(*held, strict=True))
    assert auc(score, label) > 0.9 and (said[label == 0] == 0).mean() > 0.95


def test_network_gradient():
    """All gradients, embeddings included, against differences of the loss; pooled values against plain sums."""
    r = np.random.default_rng(0)
    texts = [r.integers(0, 50, (8, 1 + len(op5_toxicity.STEMS))) for _ in range(6)]
    y, weight = np.array([0, 1, 1, 0, 1, 0.0]), np.array([1, 2, 1, 1, 0.5, 1.0])
    net = op5_toxicity.Network()
    ids, start = op5_toxicity._joined(texts)
    z, h, where, x = net.forward(ids, start, keep=True)
    assert np.allclose(z, net.forward(ids, start))
    for n, w in enumerate(op5_toxicity.WIDTHS):
        for d in range(6):
            for f in range(op5_toxicity.FILTERS):
                at = where[n][d, f]
                total = sum(x[at + j] @ net.p[f"k{w}"][j][:, f] for j in range(w)) + net.p[f"b{w}"][f]
                assert max(total, 0) == pytest.approx(h[d, n * op5_toxicity.FILTERS + f])

    def loss():
        z = net.forward(ids, start)
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-4 * (net.p["out"] ** 2).sum())

    def slope(a, at, step=1e-6):
        kept = a[at]
        a[at] = kept + step
        up = loss()
        a[at] = kept - step
        down = loss()
        a[at] = kept
        return (up - down) / (2 * step)

    g, used, ge = net.gradient(ids, weight * (1 / (1 + np.exp(-z)) - y), h, where, x)
    for name, grad in g.items():
        for at in list(np.ndindex(grad.shape))[:40]:
            assert grad[at] == pytest.approx(slope(net.p[name], at), abs=1e-5), (name, at)
    assert np.abs(ge).max() > 1e-3
    for row, grad in zip(used, ge, strict=True):
        for e in range(op5_toxicity.WIDTH):
            if row != op5_toxicity.PAD:
                assert grad[e] == pytest.approx(slope(net.p["e"], (row, e)), abs=1e-5)


def test_toxicity_equals_a_plain_version(spark):
    """Scores of the query from the fitted network's parameters, word by word and filter by filter."""
    import re

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    net = op5_toxicity.fit(docs, labels)
    from gristmill.llm.op5_toxicity import PAD, word_ids
    from gristmill.llm.textops import buffers

    import pyarrow as pa

    number = lambda w: word_ids(*buffers(pa.array([w])))[0][0]
    got = {r.doc_id: r.score for r in op5_toxicity.toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    for r in docs.limit(40).collect():
        found = [number(w) for w in re.findall(r"(?:[A-Za-z]|[^\x00-\x7F])+", r.text or "")]
        guess = sum((net.lang[ids[0]] for ids in found), np.zeros(net.lang.shape[1]))
        x = [sum(net.p["e"][k] for k in ids) for ids in found] + [np.zeros(op5_toxicity.WIDTH)] * 6
        assert not net.p["e"][PAD].any()
        z = float(net.p["bias"][0])
        for n, w in enumerate(op5_toxicity.WIDTHS):
            for f in range(op5_toxicity.FILTERS):
                best = max(sum(x[i + j] @ net.p[f"k{w}"][j][:, f] for j in range(w)) for i in range(len(found) + 3)) + net.p[f"b{w}"][f]
                z += max(0, best) * net.p["out"][n * op5_toxicity.FILTERS + f]
        if net.curve:
            slope, offset = net.curve.get(int(np.argmax(guess)) if len(guess) else 0, net.curve[-1])
            z = slope * z + offset
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=2e-3)


def test_quality_equals_a_plain_version(documents, labels):
    """Scores of the query from the tables of a model fitted on the same rows, bin by bin."""
    table = op4_quality.feature_table(documents).collect()
    x = {r.id: np.frombuffer(r.x, np.float32).astype(float) for r in table}
    y = {r.doc_id: r.quality for r in labels.collect() if remainder(r.doc_id, 5) and r.doc_id in x}
    ids = sorted(y)
    model = op4_quality.Additive().fit(np.array([x[i] for i in ids]), np.array([y[i] for i in ids], float))
    assert len(model.pairs) == model.n_pairs
    place = lambda v, edges: sum(v >= e for e in edges)
    for r in op4_quality.quality(documents, labels).collect()[:300]:
        f = model.base + sum(model.tables[j][place(v, model.edges[j])] for j, v in enumerate(x[r.doc_id]))
        for (a, b), t in zip(model.pairs, model.tables2, strict=True):
            f += t[place(x[r.doc_id][a], model.edges2[a]) * model.coarse + place(x[r.doc_id][b], model.edges2[b])]
        assert r.score == pytest.approx(1 / (1 + np.exp(-f)), abs=1e-9)


def test_fitting_sample_size(spark, monkeypatch):
    """12,000 labelled rows of the training folds are all fitted on or calibrated with."""
    ids = [i for i in range(16_000) if remainder(i, 5)][:12_000]
    docs = spark.createDataFrame([(i, f"word{i % 7} text", "en") for i in ids], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    used = []
    monkeypatch.setattr(op5_toxicity.Network, "fit", lambda self, texts, y: used.append(len(texts)))
    monkeypatch.setattr(op5_toxicity.Network, "calibrate", lambda self, texts, y: used.append(len(texts)))
    op5_toxicity.fit(docs, labels)
    assert sum(used) == 12_000


def test_calibration():
    r = np.random.default_rng(4)
    z = r.normal(0, 3, 20_000)
    y = (r.random(20_000) < 1 / (1 + np.exp(-(1.5 * z - 2)))).astype(float)
    assert np.allclose(calibration(z, y), (1.5, -2), atol=0.15)
    slope, offset = calibration(np.array([0.1, 0.2, 0.8, 0.9] * 50), np.array([0, 0, 1, 1] * 50))
    assert 0.2 < -offset / slope < 0.8


def test_language(documents):
    truth = {r.doc_id: r.lang for r in documents.collect()}
    got = op7_language.identify(documents).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r.held_out == (remainder(r.doc_id, 4) == 2) and 0 <= r.score <= 1
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) > 0.97


def plain_trigrams(text):
    """Trigrams of lower-case letters; what lies between words is one blank."""
    import regex

    s = "".join(f" {w}" for w in regex.findall(r"\p{L}+", text or ""))
    s = [c.lower()[0] if c != " " else " " for c in s] + [" "]
    return [tuple(s[i : i + 3]) for i in range(len(s) - 2)] if len(s) > 1 else []


def plain_bundle(found):
    letter = lambda c: op7_language.letter_vectors(np.array([0 if c == " " else ord(c)]))[0].astype(int)
    out = np.zeros(op7_language.WIDTH, int)
    for (a, b, c), n in collections.Counter(found).items():
        out += n * np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return out


def test_language_equals_a_plain_version(spark):
    """Alphabets of one family and texts without spaces; every prediction and score from plain loops over all rows."""
    r = random.Random(6)
    letters = {"ru": "оеаинтсрвл", "uk": "оанівирте", "el": "αοιετσνηυρ", "zh": "的一是不了人我在有他这中大来上", "ja": "のにはをたがでてとしれさある日人", "en": "etaoinshrd", "de": "enisratdhu"}
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(2, 7)))
    vocabulary = {k: [word(a) for _ in range(60)] for k, a in letters.items()}
    rows = []
    for i in range(420):
        lang = r.choice([*letters])
        between = "" if lang in ("zh", "ja") else " "
        rows.append((i, between.join(r.choice(vocabulary[lang]) for _ in range(r.randint(3, 30))) + r.choice(["", "!", " 12"]), lang))
    rows += [(1000, None, "ru"), (1001, "12 34", "ru"), (1002, "", None), (1003, rows[0][1].upper(), None)]
    held = lambda i: remainder(i, 4) == 2
    proto = {}
    for i, t, lang in rows:
        if lang and not held(i):
            proto[lang] = proto.get(lang, 0) + plain_bundle(plain_trigrams(t))
    got = {x.doc_id: x for x in op7_language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    right = []
    for i, t, lang in rows:
        v = plain_bundle(plain_trigrams(t))
        assert got[i].held_out == held(i)
        if not v.any():
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        cos = {k: v @ p / np.linalg.norm(v) / np.linalg.norm(p) for k, p in sorted(proto.items())}
        best = max(cos, key=cos.get)
        assert got[i].score == pytest.approx(max(0, cos[best]), abs=1e-4) and cos[got[i].lang_pred] == pytest.approx(cos[best], abs=1e-4)
        if held(i) and lang:
            right.append(got[i].lang_pred == lang)
    assert len(right) > 60 and np.mean(right) > 0.95


def test_odd_rows(spark, odd, labels):
    for f in (lambda d: op4_quality.quality(d, labels), lambda d: op5_toxicity.toxicity(d, labels), op7_language.identify):
        got = f(odd).collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted([1, 2, 3, 3, 4, 5, 6, None], key=str)
        assert all(0 <= r.score <= 1 for r in got)
        assert f(odd.limit(0)).collect() == []
    by = {r.doc_id: r.lang_pred for r in op7_language.identify(odd).collect()}
    assert by[1] == by[2] == by[3] == by[5] == "und" and by[4] != "und"


def test_without_labels(spark, odd, labels):
    assert {round(r.score, 6) for r in op4_quality.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in op5_toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.0}


# -- chat --------------------------------------------------------------------------------------------------


def test_chat_roles_and_rows(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    got = op10_chat.parse_transcripts(rows).collect()
    assert len(got) == rows.count()
    held = [r.role == r.role_pred for r in got if r.held_out]
    assert np.mean(held) > 0.9
    for r in got:
        assert r.rendered.count("<|end|>") == r.n_turns == len(r.roles)


def test_markers_split_a_row(spark):
    text = "System: be brief\nUser: hello\nthere\nAssistant: hi\nHuman: bye"
    rows = spark.createDataFrame([(1, 0, None, text)], "conv_id long, turn long, role string, text string")
    (r,) = op10_chat.parse_transcripts(rows).collect()
    assert r.roles == ["system", "user", "assistant", "user"]
    assert r.rendered == "<|system|>\nbe brief\n<|end|>\n<|user|>\nhello\nthere\n<|end|>\n<|assistant|>\nhi\n<|end|>\n<|user|>\nbye\n<|end|>"


def test_blocks_decode_as_one_sequence():
    r = random.Random(2)
    model = op10_chat.Model({(op10_chat.MOVE, 1, 2): 30, (op10_chat.MOVE, 2, 1): 25, (op10_chat.MOVE, 2, 2): 5, (op10_chat.BEGIN, 0, 1): 9, (0, 1, 3): 9, (0, 2, 7): 9})
    lines = [x for _ in range(60) for x in op10_chat.observed("x" * r.choice([1, 5, 100, 300]) + r.choice(["?", ".", ""]) + ("\nUser: a" if r.random() < 0.1 else ""), 3)]
    whole = model.viterbi(lines, None, np.zeros(3))
    cut = [0, 17, 40, len(lines)]
    parts = [lines[a:b] for a, b in zip(cut, cut[1:], strict=False)]
    mats = [model.matrix(p, i == 0) for i, p in enumerate(parts)]
    before, score = [], np.zeros(3)
    for m in mats:
        before.append(score)
        score = (score[:, None] + m).max(axis=0)
    after, score = [], np.zeros(3)
    for m in reversed(mats):
        after.insert(0, score)
        score = (m + score[None]).max(axis=1)
    got = [s for i, p in enumerate(parts) for s in model.viterbi(p, None if i == 0 else before[i], after[i])]
    assert got == whole


def test_viterbi_finds_the_best_of_all_paths():
    r = random.Random(9)
    model = op10_chat.Model({(op10_chat.MOVE, 1, 2): 30, (op10_chat.MOVE, 2, 1): 25, (op10_chat.BEGIN, 0, 1): 9, (0, 1, 3): 9, (0, 2, 7): 9, (op10_chat.TOLD, 1, 1): 5})
    for _ in range(30):
        lines = [x for k in range(3) for x in op10_chat.observed("x" * r.choice([1, 5, 100]) + r.choice(["?", ".", "\n- a", "\nUser: a"]), k)][:7]

        def score(path):
            total, before = 0.0, 0
            for k, (line, state) in enumerate(zip(lines, path, strict=True)):
                move, emit = model.step(line, k == 0)
                total, before = total + move[before, state] + emit[state], state
            return total

        best = max(score(p) for p in itertools.product(range(3), repeat=len(lines)))
        assert score(model.viterbi(lines, None, np.zeros(3))) == pytest.approx(best)


def plain_chat(rows):
    """{(conv, turn, text): (role, rendered)}: counts from training rows, then every conversation decoded as one sequence."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn if turn is not None else -(2**62), text or "", role))
    counts = collections.Counter()
    for conv, own in by.items():
        own.sort(key=lambda x: x[:2])
        if conv is None or remainder(conv, 5) == 0:
            continue
        before = None
        for k, (_, text, role) in enumerate(x for x in own if x[2] is not None):
            lines = op10_chat.observed(text, k)
            state = op10_chat.ROLES.index(role) if role in op10_chat.ROLES else None
            if state is not None:
                if before is not None:
                    counts[op10_chat.MOVE, before, state] += 1
                elif k == 0:
                    counts[op10_chat.BEGIN, 0, state] += 1
                if lines[0][0] >= 0:
                    counts[op10_chat.TOLD, state, lines[0][0]] += 1
                if len(lines) > 1 and all(x[0] < 0 for x in lines[1:]):
                    counts[op10_chat.KEPT, 0, 0] += len(lines) - 1
                for f, v in enumerate(lines[0][2]):
                    counts[f, state, v] += 1
            before = state
    model, out = op10_chat.Model(counts), {}
    for conv, own in by.items():
        parts = [op10_chat.observed(text, k) for k, (_, text, _) in enumerate(own)]
        path, at = model.viterbi([x for p in parts for x in p], None, np.zeros(3)), 0
        for (turn, text, _), p in zip(own, parts, strict=True):
            out[conv, turn, text] = (op10_chat.ROLES[path[at]], op10_chat.render(p, path[at : at + len(p)])[0])
            at += len(p)
    return out


def test_chat_equals_a_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = plain_chat(rows)
    got = op10_chat.parse_transcripts(df).join(df.select("conv_id", "turn", "text").distinct(), ["conv_id", "turn"]).collect()
    assert got and all(want[r.conv_id, r.turn, r.text] == (r.role_pred, r.rendered) for r in got)


def test_long_conversation_and_odd_rows(spark):
    r = random.Random(3)
    rows = [(7, i, None, r.choice(["ok", "why?", "line " * 20, "- a\n- b"])) for i in range(700)]
    rows += [(9, i, r.choice(["user", "assistant"]), f"line {i} " * r.choice([1, 20])) for i in range(40)]
    rows += [(8, None, None, None), (8, None, None, ""), (8, 3, "narrator", "x"), (None, 1, "user", "y"), (8, 3, "narrator", "x"), (8, 5, None, "long " * 200_000)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "conv_id long, turn long, role string, text string, conv string, block long")
    got = op10_chat.parse_transcripts(df).collect()
    assert len(got) == len(rows)
    want = plain_chat(rows)
    ours = {r.turn: (r.role_pred, r.rendered) for r in got if r.conv_id == 7}
    # three blocks, decoded as all lines at once
    assert ours == {t: v for (c, t, _), v in want.items() if c == 7}
    assert op10_chat.parse_transcripts(df.limit(0)).collect() == []


# -- graph and pipeline ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [0, 40, 10**6])
def test_components(spark, bound):
    r = random.Random(bound)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 400), r.randrange(100, 400)) for _ in range(220)] + [(500, x) for x in range(501, 560)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    want = {x: root(x) for a, b in edges if a != b for x in (a, b)}
    got = {x.node: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long"), task_edges=bound).collect()}
    assert got == want


def test_pipeline_stages(spark, documents, labels):
    docs, at = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out = out.cache()
        at[name] = (docs, out)
        if name != "pack":
            assert out.columns == documents.columns
        docs = out
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())

    before, after = at["quality"]
    scored = {r.doc_id: r.predicted for r in op4_quality.quality(before, labels).collect()}
    assert ids(after) == sorted(i for i, p in scored.items() if p)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([i in set(ids(after)) for i, q in truth.items() if q == 1]) > 0.97

    before, after = at["exact_dedup"]
    last = {}
    for r in before.collect():
        t = (r.text or "").translate(FOLD)
        last[t] = max(last.get(t, -1), r.doc_id)
    assert ids(after) == sorted(last.values())

    before, after = at["near_dedup"]
    want = components([(r.doc_id, r.text) for r in before.collect()], 80, 100)
    assert ids(after) == sorted({c for _, c in want.values()})

    before, after = at["mix"]
    size = {r.doc_id: len(words(r.text)) for r in before.collect()}
    count = {}
    for i in ids(after):
        count[i] = count.get(i, 0) + 1
    assert max(count.values()) <= 2
    assert sum(size[i] * n for i, n in count.items()) == pytest.approx(1.5 * sum(size.values()), rel=0.02)

    before, after = at["pack"]
    assert set(ids(after)) == set(ids(before))


def test_intermediate_tables_are_deleted(spark, documents):
    """When an operator returns, the shared folder holds only what its result reads."""
    from pathlib import Path

    from gristmill.llm import op2_substring, op6_mix, op8_forest, op9_exact

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    for f in (op2_substring.remove_repeats, op6_mix.mix, op8_forest.near_dedup, op9_exact.exact_dedup):
        before = set(shared.iterdir())
        out = f(documents)
        left = {x.name for x in set(shared.iterdir()) - before}
        assert left == {p for file in out.inputFiles() for p in file.split("/") if p and (shared / p).is_dir() and (shared / p) not in before}
        assert len(left) <= 6 and out.count() == documents.count()


def test_tables_of_few_rows_take_few_tasks(spark):
    """Sums by source, components and long signatures are not written by as many tasks as texts are dealt to."""
    from gristmill.llm import op6_mix, op8_forest

    r, n = random.Random(6), 96
    base = [[f"w{r.randrange(10**6)}" for _ in range(100)] for _ in range(2)]
    texts = [" ".join(base[i % 2][:95] + [f"x{r.random()}" for _ in range(r.choice([1, 5, 30]))]) for i in range(120)]
    df = spark.createDataFrame([(i, t, r.choice(["a", "b", "c", None])) for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1).localCheckpoint()
    settings = {"spark.sql.shuffle.partitions": n, "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, sc = {k: spark.conf.get(k) for k in settings}, spark.sparkContext
    tasks = {}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        for name, f in (("mix", op6_mix.mix), ("near", op8_forest.near_dedup)):
            sc.setJobGroup(f"few-{name}", name)
            f(df)
            infos = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup(f"few-{name}") for s in sc.statusTracker().getJobInfo(j).stageIds]
            tasks[name] = sum(x.numCompletedTasks for x in infos if x) / n
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        sc.setLocalProperty("spark.job.description", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tasks["mix"] < 16 and tasks["near"] < 11, tasks


def test_exact_stage_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b", None, "s", 3), (1, "a b", None, "s", 3), (2, "A b", None, "s", 3), (2, "A b", None, "s", 3), (3, "c", None, None, 1), (3, "d", None, None, 1), (None, "e", None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.exact_dedup(spark, df, SF).collect()), key=str)
    assert got == sorted([(2, "A b"), (3, "c"), (3, "d"), (None, "e")], key=str)


def test_stages_with_clashing_names(spark, labels):
    """Extra columns with the names that stages use themselves come through unchanged; rows that share an id, nulls and empty texts too."""
    names = ["copies", "copy", "sha", "sha_", "kept_id", "kept_sha", "mixed_id", "times", "own_id", "document", "id", "n", "text_sha256", "kept", "component_id", "size", "digest", "label"]
    r = random.Random(12)
    texts = [" ".join(f"word{r.randrange(400)}" for _ in range(r.randint(20, 200))) for _ in range(30)] + [None, "", "x"]
    rows = [(i, t, "en", r.choice(["a", "b", None]), 1, *([f"{i}"] * len(names))) for i, t in enumerate(texts)]
    rows += [rows[0], (5, "another text of a shared id " * 9, "en", "a", 1, *(["s"] * len(names))), (None, "null id " * 12, "en", "a", 1, *(["s"] * len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF).collect()
        if name == "pack":
            continue
        assert out and out[0].__fields__ == df.columns and {tuple(x) for x in out} <= set(rows), name
        if name == "exact_dedup":
            assert len(out) == len(set(rows)) - 1
        if name == "near_dedup":
            assert sorted(map(str, out)) == sorted(map(str, df.collect()))


def test_stages_on_an_empty_table(spark, documents):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), SF).collect() == []
