import collections
import itertools
import math
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prsloom.llm import chains, common, hmm, language_id

RNG = np.random.default_rng(0)
SOUNDS = {"en": ["the", "ing", "tion", "and", "er", "ha", "st"], "de": ["ung", "sch", "ein", "keit", "ver", "ö", "tz"], "fr": ["eau", "é", "oi", "que", "ment", "è", "ou"]}


def text(lang, words):
    return " ".join("".join(RNG.choice(SOUNDS[lang], RNG.integers(1, 4))) for _ in range(words))


def test_scan_equals_one_step_at_a_time():
    s = 3
    step = RNG.random((s, s))
    start = np.array([0.2, 0.3, 0.5])
    lengths = np.array([1, 0, 31, 32, 33, 70, 200])
    x = RNG.random((lengths.sum(), s))
    gamma, moves, total = chains.posteriors(x, step, start, lengths)
    off = np.r_[0, np.cumsum(lengths)]
    want = np.zeros((s, s))
    for d in range(len(lengths)):
        xs = x[off[d] : off[d + 1]]
        alpha, c, v = [], 0.0, start
        for t in xs:
            v = (v @ step) * t
            c += math.log(v.sum())
            v = v / v.sum()
            alpha.append(v)
        assert c == pytest.approx(total[d]) and c == pytest.approx(chains.log_likelihood(x, step, start, lengths)[d])
        beta = np.ones(s)
        for t in range(len(xs) - 1, -1, -1):
            g = alpha[t] * beta
            np.testing.assert_allclose(g / g.sum(), gamma[off[d] + t])
            m = (alpha[t - 1] if t else start)[:, None] * step * (xs[t] * beta)[None]
            want += m / m.sum()
            beta = step @ (xs[t] * beta)
            beta /= beta.sum()
    np.testing.assert_allclose(want, moves)


def test_language_of_held_out_and_mixed(documents):
    langs = list(SOUNDS)
    rows = [(k, text(langs[k % 3], 40), langs[k % 3]) for k in range(240)]
    # a mixed text is no teacher, or its French words would be learned as German
    rows += [(1000, text("de", 60) + " " + text("fr", 20), None), (1001, "12 34 !!", "en"), (1002, None, "en"), (1003, text("fr", 5), None)]
    got = {r.doc_id: r for r in language_id.identify(documents(rows)).collect()}
    held = [k for k in range(240) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert all(got[k].held_out == (k in held) for k in range(240))
    assert np.mean([got[k].lang_pred == langs[k % 3] for k in held]) > 0.97
    assert got[1000].lang_pred == "de" and 0.6 < got[1000].score < 0.9 and got[1000].n_switches >= 1
    assert (got[1001].lang_pred, got[1001].score) == ("und", 0.0) and got[1002].lang_pred == "und" and got[1003].lang_pred == "fr"
    kept = {r.doc_id for r in language_id.accepted(documents(rows)).collect()}
    assert kept == set(got) - {1001, 1002}


def test_languages_are_learned_in_a_task(documents, monkeypatch):
    """Training takes memory by the lengths of the texts: the driver only gets the weights."""
    driver, train = os.getpid(), language_id.train

    def elsewhere(*args):
        assert os.getpid() != driver
        return train(*args)

    langs = list(SOUNDS)
    rows = [(k, text(langs[k % 3], 30), langs[k % 3]) for k in range(60)]
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    docs = documents(rows)
    drawn = docs.selectExpr("doc_id", "pmod(xxhash64(cast(doc_id as string), text), 1L << 40) as h").collect()
    h = {r.doc_id: r.h for r in drawn}
    few = [r for lang in sorted(langs) for r in sorted((x for x in kept if x[2] == lang), key=lambda x: h[x[0]])[:9]]
    weights, moves = train([r[1] for r in few], np.array([sorted(langs).index(r[2]) for r in few]), 3)
    monkeypatch.setattr(language_id, "train", elsewhere)
    got = language_id.learn(docs, 9)
    assert got[0] == sorted(langs)
    np.testing.assert_allclose(got[1], weights, atol=1e-5)
    np.testing.assert_allclose(got[2], moves, atol=1e-8)


def test_no_labels(documents):
    assert {r.lang_pred for r in language_id.identify(documents([(1, "some words", None)])).collect()} == {"und"}


def test_hmm_base_and_gain(documents):
    langs = list(SOUNDS)
    rows = [(k, text(langs[k % 3], int(RNG.integers(1, 60))), "x") for k in range(300)] + [(900, None, "x"), (901, "", "x")]
    got = {r.doc_id: r for r in hmm.score(documents(rows).repartition(7), states=3).collect()}
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tokens = {k: [*(t or "").encode().translate(lower).split(), b"\n"] for k, t, _ in rows}
    held = {k for k in tokens if zlib.crc32(str(k).encode()) % 7 == 2}
    count = collections.Counter(w for k, x in tokens.items() if k not in held for w in x)
    n, v = sum(count.values()), len(count)
    for k, x in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (k in held, len(x), sum(count[w] > 0 for w in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x))
    assert sum(got[k].score for k in held) > sum(got[k].base_score for k in held)


def test_hmm_does_not_depend_on_the_order_of_rows(documents, monkeypatch):
    """The seed is drawn from all blocks: sources stored one after another count as much as mixed ones."""
    monkeypatch.setattr(hmm, "SEED_WORDS", 400)
    langs = list(SOUNDS)
    rows = [(k, text(langs[k // 100], 30), "x") for k in range(300)]
    one, two = ({r.doc_id: r.score for r in hmm.score(documents(x).coalesce(1), states=3).collect()} for x in (rows, rows[::-1]))
    assert one == pytest.approx(two, rel=1e-6)


def brute_forward(emit, step, start, kinds):
    """Sums over all paths of states, one by one: likelihood and expected counts."""
    s = len(start)
    total, moves, seen = 0.0, np.zeros((s, s)), np.zeros((s, emit.shape[1]))
    for path in itertools.product(range(s), repeat=len(kinds)):
        # what the model calls start is the state before the first word
        p = sum(start[z] * step[z, path[0]] for z in range(s)) * emit[path[0], kinds[0]]
        for a, b, k in zip(path, path[1:], kinds[1:], strict=False):
            p *= step[a, b] * emit[b, k]
        total += p
        for a, b in zip(path, path[1:], strict=False):
            moves[a, b] += p
        for a, k in zip(path, kinds, strict=True):
            seen[a, k] += p
    return total, moves / total, seen / total


def test_baum_welch_step_and_forward_equal_all_paths(monkeypatch):
    rng = np.random.default_rng(5)
    s, k = 3, 6
    monkeypatch.setattr(hmm, "CLASSES", k)
    emit, step = rng.random((s, k)), rng.random((s, s))
    emit /= emit.sum(1, keepdims=True)
    step /= step.sum(1, keepdims=True)
    start = np.full(s, 1 / s)
    texts = [rng.integers(0, k, n) for n in (1, 4, 6)]
    told = [brute_forward(emit, step, start, t) for t in texts]
    kinds, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
    classes, moves, _, likely = hmm.expectation(emit, step, start, kinds, lengths)
    np.testing.assert_allclose(likely, sum(math.log(x[0]) for x in told))
    np.testing.assert_allclose(moves, sum(x[1] for x in told), atol=1e-9)
    np.testing.assert_allclose(classes, sum(x[2] for x in told), atol=1e-9)
    x = emit.T[kinds]
    np.testing.assert_allclose(chains.log_likelihood(x, step, start, lengths), [math.log(x[0]) for x in told])


def test_hmm_counts_words_that_span_batches():
    """Answers to blocks do not depend on how the rows of a word are cut into batches."""
    rng = np.random.default_rng(6)
    h = np.sort(rng.integers(0, 6, 200))
    block, place, n = np.arange(200), rng.integers(0, 9, 200).astype(np.int32), rng.integers(0, 5, 200).astype(np.int32)
    want = np.bincount(h, n)

    def answers(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[a : a + size]) for x in (h, block, place, n, (h % 3).astype(np.int32))], ["hash", "block", "place", "n", "class"]) for a in range(0, 200, size)]
        return [r for b in hmm._answer(iter(batches)) for r in b.to_pylist()]

    for size in (1, 7, 64, 200):
        told = {r["block"]: int(np.frombuffer(r["totals"], np.int64)[0]) for r in answers(size) if r["block"] >= 0}
        assert told == {int(b): int(want[w]) for b, w, c in zip(block, h, n, strict=True) if want[w] != c}


def test_gradient_features_of_a_word():
    """Buckets of a word are those of its affixes, its n-grams and itself, counted one by one."""
    low, starts, ends, back, _ = language_id.distinct(*common.text_bytes(pa.array(["abcab x"])))
    buckets, many = language_id.features(low, language_id.byte_hasher(low), starts, ends)
    # three prefixes, four suffixes and the word, and all grams of two and three letters
    assert sorted(many.tolist()) == [8, 8 + 4 + 3]
    assert ((buckets >= 0) & (buckets < 1 << language_id.BITS)).all()


def test_hmm_probabilities_sum_to_one():
    """Over one-word texts of every class, end included: sum of P(class sequence) is the chance of two tokens."""
    rng = np.random.default_rng(1)
    s, k = 3, 5
    emit, step = rng.random((s, k)), rng.random((s, s))
    emit /= emit.sum(1, keepdims=True)
    step /= step.sum(1, keepdims=True)
    start = np.full(s, 1 / s)
    total = sum(math.exp(chains.log_likelihood(emit.T[[a, b]], step, start, np.array([2]))[0]) for a in range(k) for b in range(k))
    assert total == pytest.approx(1.0)


def test_cut_and_whole_sequences_agree(monkeypatch):
    """Whether a sequence runs through or is cut into blocks makes no difference."""
    rng = np.random.default_rng(2)
    lengths = np.array([1, 3, 0, 200, 64, 65, 2, 0, 40])
    x, step, start = rng.random((lengths.sum(), 4)), rng.random((4, 4)), rng.random(4)
    start /= start.sum()
    told = []
    for whole in (1, 64, 1024):
        monkeypatch.setattr(chains, "WHOLE", whole)
        told.append([*chains.posteriors(x, step, start, lengths), chains.log_likelihood(x, step, start, lengths)])
    for other in told[1:]:
        for a, b in zip(told[0], other, strict=True):
            np.testing.assert_allclose(a, b, atol=1e-9)
    np.testing.assert_allclose(told[0][2], told[0][3])
