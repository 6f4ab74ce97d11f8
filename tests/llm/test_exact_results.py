"""Operators whose results are exact, against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from brute import components, remove_repeats, shingle_set

from gristmill.llm import op1_fingerprint, op2_substring, op3_pack, op6_mix, op8_forest, op9_exact

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string"


def odd_rows():
    """Nulls, empty and long texts, ties, copies and near copies, with columns whose names clash."""
    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 120))) for _ in range(40)]
    passage = " ".join(r.choice(vocabulary) for _ in range(30))
    texts += [t.upper() for t in texts[:5]] + texts[5:9] + [None, "", " \t\n", "one", "One", "é É", "a b c d", "A b c d"]
    texts += [f"{t} {passage} x {t[:20]}" for t in texts[10:16]] + [passage, passage + " " + passage, " ".join(vocabulary * 60), "😀 " * 50, "a <|endoftext|> b<|endoftext|>", "<|endoftext|>"]
    for t in [" ".join(r.choice(vocabulary) for _ in range(100)) for _ in range(4)]:
        for _ in range(6):
            w = t.split()
            w[r.randrange(len(w))] = "edit" + str(r.random())
            texts.append(" ".join(w))
    return [(i * 7 % 1009, t, None, r.choice(["a", "b", None, "B"]), None, 5, "x") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_repeats(which, request):
    df = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op2_substring.remove_repeats(df).collect()}
    assert got == remove_repeats(pairs(df))
    assert sum(x[1] for x in got.values()) > 0


@pytest.mark.parametrize("word_bits", [1, 6])
def test_repeats_with_colliding_hashes(odd, word_bits):
    """Nearly all words collide in the first hash; the other one still tells windows apart."""
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op2_substring.remove_repeats(odd, word_bits=word_bits).collect()}
    assert got == remove_repeats(pairs(odd))


@pytest.mark.parametrize(("size", "base"), [(20, 5), (16, 2), (12, 12)])
def test_repeats_at_several_levels(odd, size, base):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op2_substring.remove_repeats(odd, size=size, base=base).collect()}
    assert got == remove_repeats(pairs(odd), size)


def test_no_repeats(spark):
    """No candidate survives the first level."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(5)]
    got = op2_substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(i, 60, 0) for i in range(5)]


def test_repeated_rows_are_one_document(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_removed) for r in op2_substring.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 0), (2, 40)]


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_near_dedup(which, request):
    df = request.getfixturevalue(which)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_forest.near_dedup(df).collect()}
    assert got == components(pairs(df), 85, 100)


def test_near_dedup_of_crowded_groups(spark):
    """Groups far over a block: copies of a base, some linked only to the base and some to nothing."""
    r = random.Random(5)
    rows = []
    for _ in range(2):
        base = [f"w{r.randrange(10**6)}" for _ in range(200)]
        rows.append(base)
        for _ in range(700):
            w, at = base[:], r.randrange(190)
            w[at : at + r.choice([1, 3, 9, 12, 30])] = [f"x{r.random()}"]
            rows.append(w)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in op8_forest.near_dedup(df).collect()} == components(rows, 85, 100)


def test_near_dedup_of_a_shared_template(spark):
    """Every document has the same template and one partner. The seed is one where neighbours in the order alone part a linked pair."""
    r = random.Random(14)
    template = [f"t{r.randrange(10**6)}" for _ in range(320)]
    texts = []
    for _ in range(700):
        w = [f"w{r.randrange(10**6)}" for _ in range(80)]
        for _ in range(2):
            texts.append(" ".join(template + w))
            for at in r.sample(range(4, 80, 6), 6):
                w[at] = f"x{r.random()}"
    ids = r.sample(range(10**6), len(texts))
    sets = [shingle_set(t) for t in texts]
    for a, b, c in zip(sets[0::2], sets[1::2], sets[2::2], strict=False):
        assert 100 * len(a & b) >= 85 * len(a | b) and 100 * len(b & c) < 75 * len(b | c)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    want = {i: min(pair) for pair in zip(ids[0::2], ids[1::2], strict=True) for i in pair}
    assert {x.doc_id: x.component_id for x in op8_forest.near_dedup(df).collect()} == want


def template_pairs(n, own, seed):
    """n texts with one template; each has one partner with a likeness of about 0.9, and (from 40 own words) all others are below 0.8."""
    r = random.Random(seed)
    template = [f"t{r.randrange(10**6)}" for _ in range(320)]
    rows = []
    for i in range(n // 2):
        w = [f"w{r.randrange(10**7)}" for _ in range(own)]
        rows.append((2 * i, " ".join(template + w)))
        for at in r.sample(range(4, own, 6), 4):
            w[at] = f"x{r.random()}"
        rows.append((2 * i + 1, " ".join(template + w)))
    return rows


@pytest.mark.parametrize("own", [40, 60])
def test_template_work_grows_with_documents(spark, monkeypatch, own):
    """No link is lost where all documents share a template, and the sets that are sent grow as the documents do."""
    from gristmill.llm import graph, linkage, store

    sent = {}

    def counted(df, name):
        out = store.materialize(df, name)
        if name in ("link-sets", "link-turned"):
            sent[name] = sent.get(name, 0) + out.count()
        return out

    for module in (op8_forest, linkage, graph):
        monkeypatch.setattr(module, "materialize", counted)
    rows = {}
    for n in (600, 2400):
        sent.clear()
        df = spark.createDataFrame(template_pairs(n, own, 5), "doc_id long, text string").repartition(4)
        assert all(r.component_id == r.doc_id // 2 * 2 for r in op8_forest.near_dedup(df).collect())
        rows[n] = sent["link-sets"] + 2 * sent["link-turned"]
    assert rows[2400] < 1.3 * 4 * rows[600]


def test_links_through_one_base(spark):
    """Every copy is linked with the base alone: copies differ in other places, so that they are below the threshold among themselves."""
    r = random.Random(8)
    base = [f"w{r.randrange(10**6)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 900):
        w = base[:]
        for at in r.sample(range(0, 390, 10), 5):
            w[at] = f"x{r.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in op8_forest.near_dedup(df).collect()} == components(rows, 85, 100)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_bands_and_jaccard(which, request):
    df = request.getfixturevalue(which)
    got = {r.doc_id: r.component for r in op1_fingerprint.fingerprints_with_groups(df).collect()}
    assert got == {i: c for i, (_, c) in components(pairs(df), 80, 100).items()}


def test_bands_of_a_shared_template(spark):
    """Bands that hundreds of documents share: at least nine in ten linked pairs are found, and nothing else is linked."""
    rows = template_pairs(1200, 60, 9)
    got = {r.doc_id: r.component for r in op1_fingerprint.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) <= set(range(0, 1200, 2)) and all(c == i // 2 * 2 for i, c in got.items())
    assert len(got) >= 0.9 * len(rows)


def test_no_partner_is_lost_in_crowded_bands(spark):
    """Bands of a thousand documents, where the partner is seldom among the first and the nearest members."""
    rows = template_pairs(1200, 40, 9)
    r = random.Random(3)
    place = list(range(1200))
    r.shuffle(place)
    rows = [(place[i], t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component for x in op1_fingerprint.near_duplicates(df).collect()}
    assert got == {place[i]: min(place[i], place[i ^ 1]) for i in range(1200)}


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_fingerprints(which, request):
    df = request.getfixturevalue(which)
    rows = sorted(((i, t or "") for i, t in pairs(df)), reverse=True)
    text = dict(rows)
    follows = {a: b for (a, _), (b, _) in zip(rows, rows[1:] + rows[:1], strict=True)}
    got = op1_fingerprint.fingerprint_documents(df).collect()
    assert len(got) == len(rows)
    prints = {r.doc_id: r.fingerprint for r in got}
    for r in got:
        t, n = text[r.doc_id], text[follows[r.doc_id]]
        half = len(t) // 2
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
        own, other = (np.frombuffer(bytes.fromhex(x), ">u2")[None] for x in (r.fingerprint, prints[follows[r.doc_id]]))
        assert r.near_next == pytest.approx(op1_fingerprint.likeness(own, other)[0])
        assert 0 <= r.near_edited <= 1
    by_text = {}
    for r in got:
        assert by_text.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint


def test_likeness_estimates_jaccard(documents):
    from brute import words

    def of(t):
        w = words(t)
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    rows = sorted(pairs(documents), reverse=True)
    got = {r.doc_id: r.near_edited for r in op1_fingerprint.fingerprint_documents(documents).collect()}
    off = []
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        a, b = of(t), of(t[: len(t) - len(t) // 2] + n[: len(t) // 2])
        off.append(got[i] - len(a & b) / len(a | b))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.06


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_packing_round_trip(which, request):
    import public_tokenizers
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in pairs(df)}
    rows = op3_pack.pack_documents(df).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[i])
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and len(own) <= op3_pack.SEGMENTS
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_many_short_documents(spark):
    """The limit on segments binds: no sequence has more, and none is padded."""
    rows = [(i, "a" * (i % 3)) for i in range(5000)]
    got = op3_pack.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r.length)
    assert max(map(len, sequences.values())) == op3_pack.SEGMENTS
    assert all(sum(x) == 2048 or sum(x) & (sum(x) - 1) == 0 for x in sequences.values()) and len(got) < 1.1 * len(rows)


def test_packing_of_conversations(spark):
    """Loss falls on answers alone; all three limits hold, and sequences are few."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from gristmill.llm import op10_chat

    turns = op10_chat.parse_transcripts(spark.read.parquet(f"{SF}/conversations.parquet")).cache()
    got = op3_pack.pack_conversations(turns, tokens=512, segments=6, loss=200).collect()
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    want, exchange = {}, {}
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.turn, r.rendered)):
        said, n = exchange.setdefault(r.conv_id, ["", 0])
        if r.role_pred == "assistant":
            answer = count(r.rendered + "\n") + 1
            want[r.conv_id, n] = (count(said) + answer, answer)
            exchange[r.conv_id] = ["", n + 1]
        else:
            exchange[r.conv_id][0] += r.rendered + "\n"
    for conv, (said, n) in exchange.items():
        if said:
            want[conv, n] = (count(said) + 1, 0)
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault((r.conv_id, r.exchange), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert {k: (sum(r.length for r in v), sum(r.loss for r in v)) for k, v in pieces.items()} == want
    for s in sequences.values():
        assert sum(r.length for r in s) <= 512 and len(s) <= 6 and sum(r.loss for r in s) <= 200
    assert any(sum(r.loss for r in s) > 190 for s in sequences.values()) and any(len(s) == 6 for s in sequences.values())
    least = max(sum(n for n, _ in want.values()) / 512, sum(x for _, x in want.values()) / 200, len(want) / 6)
    assert sum(1 for s in sequences.values() if sum(r.length for r in s) > 64) < 1.5 * least + 16


@pytest.mark.parametrize("cut", [True, False])
def test_packer_limits(cut):
    r = random.Random(1)
    examples = [(k, n := r.randint(1, 900 if cut else 500), r.randint(0, min(n, 300))) for k in range(700)]
    packer = op3_pack.Packer(1024, 6, 400, pool=64, cut=cut)
    made = [s for k, n, loss in examples for s in packer.add(k, n, loss)] + [*packer.finish()]
    placed = {}
    for s in made:
        assert sum(n for *_, n in s) <= 1024 and len(s) <= 6
        loss = 0
        for k, start, n in s:
            placed.setdefault(k, []).append((start, n))
            _, total, bears = examples[k]
            loss += max(0, start + n - max(start, total - bears))
        assert loss <= 400
    for k, n, _ in examples:
        at = 0
        for start, length in sorted(placed[k]):
            assert start == at
            at += length
        assert at == n and (cut or len(placed[k]) == 1)
    if not cut:
        assert len(made) < 1.15 * max(sum(n for _, n, _ in examples) / 1024, 700 / 6, sum(x for *_, x in examples) / 400)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_mix(which, request):
    from brute import words

    df = request.getfixturevalue(which)
    got = op6_mix.mix(df).collect()
    size = {i: len(words(t)) for i, t in pairs(df)}
    total = {}
    source = {r.doc_id: r.source for r in df.select("doc_id", "source").collect()}
    for i, s in source.items():
        total[s] = total.get(s, 0) + size[i]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    want, full = {}, set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        share = sum(w for s, w in weight.items() if s not in full)
        want = {s: 2 * total[s] if s in full else left * weight[s] / share for s in names}
        over = {s for s in names if want[s] > 2 * total[s]}
        if not over:
            break
        full |= over
    taken = {}
    assert len(got) == len(size)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == total[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size + r.part and 0 <= r.part < max(1, r.size)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s in names:
        assert abs(taken[s] - want[s]) <= 0.51
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op6_mix.mix(df.repartition(2)).collect()), key=str)


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_tilts_solve_the_dual(which, request):
    """Rates against nested bisection: each source's dual for a given theta, and theta."""
    df = request.getfixturevalue(which)
    got = df.select("doc_id", "source").join(op6_mix.mix(df), "doc_id").collect()
    size = np.array([r["size"] for r in got], float)
    name = np.array([str(r["source"]) for r in got])
    target = {str(r["source"]): r["target"] for r in got}
    x = np.log(np.maximum(size, 1))
    mean = (size * x).sum() / size.sum()
    x = (x - mean) / np.sqrt((size * x * x).sum() / size.sum() - mean**2)

    def rates(theta):
        out = np.zeros(len(size))
        for s, want in target.items():
            own = name == s
            if want >= 2 * size[own].sum() * (1 - 1e-12):
                out[own] = 2.0 if want else 0.0
                continue
            low, high = -30.0, 30.0
            for _ in range(200):
                mid = (low + high) / 2
                r = np.minimum(2, np.exp(mid + theta * x[own]))
                low, high = (mid, high) if (size[own] * r).sum() < want else (low, mid)
            out[own] = r
        return out

    low, high = -20.0, 20.0
    for _ in range(60):
        theta = (low + high) / 2
        off = (size * rates(theta) * x).sum() + op6_mix.SOFT * size.sum() * theta
        low, high = (theta, high) if off < 0 else (low, theta)
    want = rates(theta)
    assert len({round(r["rate"], 6) for r in got}) > 5  # documents of one source differ
    assert np.abs(np.array([r["rate"] for r in got]) - want)[size > 0].max() < 1e-5


def exact_groups(df):
    from brute import FOLD

    groups = {}
    for i, t in pairs(df):
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    return {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


@pytest.mark.parametrize("which", ["odd", "documents"])
def test_exact_dedup(which, request):
    df = request.getfixturevalue(which)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op9_exact.exact_dedup(df).collect()}
    assert got == exact_groups(df)


def test_exact_dedup_compares_bytes(odd):
    """Nearly all texts meet under one of three digests, and are still told apart."""
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op9_exact.exact_dedup(odd, digest=lambda body: str(len(body) % 3)).collect()}
    assert got == exact_groups(odd)


def test_exact_dedup_in_several_batches(spark, documents, monkeypatch):
    """State that one micro-batch wrote is read and raised by later ones, and the session's settings stay as they are."""
    from pathlib import Path

    from gristmill.llm import store

    shared, seen = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")), []

    def looked(df, name):
        if name == "dedup-keys":
            seen.append(len({*shared.glob("dedup-state-*/batch=*")}))
        return store.materialize(df, name)

    monkeypatch.setattr(op9_exact, "materialize", looked)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in op9_exact.exact_dedup(documents.repartition(4), batches=4).collect()}
    assert got == exact_groups(documents)
    assert seen[0] >= 3
    assert spark.conf.get(f"{op9_exact.STATE}.rocksdb.allowFAllocate", "unset") == "unset"


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    for f in (op1_fingerprint.fingerprint_documents, op2_substring.remove_repeats, op3_pack.pack_documents, op6_mix.mix, op8_forest.near_dedup, op9_exact.exact_dedup):
        assert f(none).collect() == []
