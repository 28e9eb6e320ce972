"""Operators against brute force on small tables."""

import base64
import collections
import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from prsloom.llm import common, decontaminate, near_dedup, packing, pii, substring_dedup, syncmers, tokens, url_rules

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def mixture(seed=0, n=60, words=120):
    """Texts with exact and near copies, shared passages and short ones."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdeimnorst"), rng.integers(2, 8))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocab, k))
    passage = say(40)
    out = []
    for k in range(n):
        kind = k % 6
        if kind == 1 and out:
            out.append(out[int(rng.integers(len(out)))])
        elif kind == 2 and out:
            w = out[int(rng.integers(len(out)))].split()
            for _ in range(max(1, len(w) // 40)):
                w[int(rng.integers(len(w)))] = "Changed"
            out.append(" ".join(w))
        elif kind == 3:
            out.append(f"{say(30)}\n{passage} {say(20)}")
        elif kind == 4:
            out.append(say(int(rng.integers(1, 6))))
        else:
            out.append(say(words))
    return out


def test_substring_dedup_brute_force(documents):
    texts = [*mixture(), "a " * 50, "a " * 45]
    first, words = {}, [t.split() for t in texts]
    for k, w in enumerate(words):
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (k, s))
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(documents(texts), width_bits=18).collect()}
    for k, w in enumerate(words):
        keep = np.ones(len(w), bool)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] != (k, s):
                keep[s : s + 20] = False
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        assert (got[k].n_words, got[k].n_removed, got[k].kept_text) == (len(w), int((~keep).sum()), kept)
        assert got[k].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_a_full_sketch_loses_nothing(documents):
    texts = mixture(1)
    small, large = ({r.doc_id: r.kept_sha256 for r in substring_dedup.substring_dedup(documents(texts), with_text=False, width_bits=b).collect()} for b in (16, 20))
    assert small == large


def test_tokenizer_equals_the_library():
    import public_tokenizers

    rng = np.random.default_rng(5)
    parts = ["a", "B", "é", "É", "ß", "×", "'s", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", " ", "\n", "1", "²", "İ", "Å", "́", "日本", "🙂", "\u0085", "\x00", "...", "don't", "I'LL", "Σ", "K", "ÿ", "Thé,", "_", "word"]
    texts = ["", *("".join(rng.choice(parts, rng.integers(1, 40))) for _ in range(1500))]
    own = tokens.WordTokenizer(public_tokenizers.path(tokens.VOCABULARY), 1)
    ids, counts = own.encode(*common.text_bytes(pa.array(texts)))
    cut = np.r_[0, np.cumsum(counts)]
    for k, t in enumerate(texts):
        assert own.tokenizer.encode(t, add_special_tokens=False).ids + [1] == ids[cut[k] : cut[k + 1]].tolist(), t


def test_code_round_trip():
    rng = np.random.default_rng(2)
    values = (2 ** rng.uniform(0, 32, 5000)).astype(np.uint64).clip(0, 2**32 - 1).astype(np.uint32)
    counts = np.array([0, 1, 2, 3, 4, 5, 0, 4985])
    control, data, n_control, n_data = tokens.code(values, counts)
    assert (tokens.decode(control, data, counts) == values).all()
    assert n_control.sum() == len(control) and n_data.sum() == len(data)


def expected_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def test_token_file_and_packing(documents, tmp_path):
    texts = [*mixture(), None, "word " * 9000]
    docs = documents(texts[::-1]).repartition(5)
    ids = expected_ids(texts[::-1])
    tokens.write_token_file(docs, str(tmp_path / "t"))
    rows = sorted(tokens.read_token_file(docs.sparkSession, str(tmp_path / "t")).collect())
    start = 0
    for r, e in zip(rows, ids, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (start, len(e), zlib.crc32(e.tobytes()), e.tolist())
        start += len(e)
    placed: dict[int, list] = {}
    seen = {}
    for r in packing.best_fit_packing(docs, capacity=256).collect():
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen[r.doc_id, r.piece] = r
    for d, e in enumerate(ids):
        for p, a in enumerate(range(0, len(e), 256)):
            r = seen.pop((d, p))
            assert (r.start, r.length, r.ids_crc32) == (a, len(e[a : a + 256]), zlib.crc32(e[a : a + 256].tobytes()))
    assert not seen
    for s in placed.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256


@pytest.mark.parametrize("seed", range(5))
def test_packing_is_tight(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, rng.integers(1, 101, 3000), 1)
    patterns = packing.pack(counts)
    used = np.zeros(101, np.int64)
    for copies, lengths in patterns:
        assert sum(lengths) <= 100
        np.add.at(used, lengths, copies)
    assert (used == counts).all()
    bound = -(-int((counts * np.arange(101)).sum()) // 100)
    assert sum(c for c, _ in patterns) <= 1.03 * max(bound, int(counts[51:].sum()))


def test_two_fit_replaces_the_smallest():
    counts = np.zeros(101, np.int64)
    for n in (60, 35, 21, 18):
        counts[n] += 1
    assert sorted(map(sorted, (x for _, x in packing.pack(counts)))) == [[18, 21, 60], [35]]


def near_brute(texts, shingle, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(LOWER).split()
        sets.append(frozenset(zip(*(w[k:] for k in range(shingle)), strict=False)) if len(w) >= shingle else frozenset([tuple(w)]) if w else frozenset())
    own = list(range(len(texts)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                own[max(x, y)] = min(x, y)
    return [(len(s), root(k)) for k, s in enumerate(sets)]


@pytest.mark.parametrize(("shingle", "seed"), [(2, 0), (5, 3)])
def test_near_duplicates_brute_force(documents, shingle, seed):
    texts = [*mixture(seed, 90), None, "", "Same", "same", "two words", "Two  WORDS"]
    got = sorted(near_dedup.near_duplicates(documents(texts), shingle).collect())
    assert [(r.n_shingles, r.component_id) for r in got] == near_brute(texts, shingle, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_long_lists_go_by_blocks(documents, monkeypatch):
    rng = np.random.default_rng(9)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(60):
        w = list(base)
        for at in rng.integers(0, 150, 4 + k % 24):
            w[at] = f"x{rng.integers(10**6)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = sorted(near_dedup.near_duplicates(documents(texts), 2).collect())
    assert [r.component_id for r in got] == [c for _, c in near_brute(texts, 2, 80)]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20, 40)] + [(1, 2)], "a long, b long")
    got = {r.node: r.comp for r in near_dedup.components(edges).collect()}
    assert got == {**{k: 20 for k in range(20, 41)}, 1: 1, 2: 1}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(LOWER).decode())


@pytest.mark.parametrize("band", [decontaminate.BAND, 3])
def test_decontaminate_brute_force(spark, documents, band):
    items = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa", "short item", "ten nine eight seven six five four three two one", None, "!!!"]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    texts = ["before ALPHA, beta gamma-delta epsilon zeta eta theta after", "a short item here", "x ten nine eight seven six five four three two one short item y", "clean text", None, "", "Ünïcode short ITEM"]
    windows: dict = {}
    for k, t in enumerate(items):
        w = words(t)
        n = min(8, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(k))
    docs = documents(texts)
    from pyspark.sql import functions as F

    hits = decontaminate.hits(docs, bench, band=band)
    got = {r.doc_id: r for r in hits.withColumn("covered", F.expr("array_sort(array_distinct(flatten(transform(hits, h -> sequence(h.at, h.at + h.k - 1)))))")).withColumn("items", F.expr("array_sort(array_distinct(flatten(transform(hits, h -> h.items))))")).collect()}
    for d, t in enumerate(texts):
        w, covered, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    covered |= set(range(s + 1, s + n + 1))
                    found |= windows[tuple(w[s : s + n])]
        assert (got[d].n_words, got[d].covered, got[d].items) == (len(w), sorted(covered), sorted(found))
    left = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert 2 not in left and left[0] == "before after" and left[1] == "a here" and left[3] == "clean text" and left[4] is None


@pytest.mark.parametrize("most", [decontaminate.MET_BYTES, 0])
def test_windows_are_broadcast_once_or_not_at_all(spark, documents, monkeypatch, most):
    """The driver builds what is broadcast: no copies for the tasks of a dealt join among it."""
    monkeypatch.setattr(decontaminate, "MET_BYTES", most)
    bench = spark.createDataFrame([(k, f"alpha beta {k}") for k in range(5)], "item_id long, text string")
    docs = documents(["x alpha beta 1", "Alpha beta 2, alpha beta 3", "clean", None])
    hits = decontaminate.hits(docs, bench)
    got = {r.doc_id: sorted((h["at"], h["k"], h["items"]) for h in r.hits) for r in hits.collect()}
    assert got == {0: [(2, 3, ["1"])], 1: [(1, 3, ["2"]), (4, 3, ["3"])], 2: [], 3: []}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert ("salt" in plan, "BroadcastExchange" in plan) == ((False, True) if most else (True, False))


def test_empty_benchmark(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judged(documents(["a b c"]), bench).collect()[0].n_hit == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((d := int(c) * (1 + k % 2)) - 9 * (d > 9) for k, c in enumerate(reversed(s))) % 10 == 0


def base_spans(t):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, t):
            n = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(n) <= 19 and luhn(n), "phone": 9 <= len(n) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(documents):
    rng = np.random.default_rng(4)
    parts = ["a.b@c.d", "@", ".", "x@y", "1.2.3.4", "0255.1.1.1", "256.1.1.1", "4111 1111-1111 1111", "4111111111111112", "+1 (269) 555-3296", "+1", "日本", "🙂", " ", "-", "9" * 25, "é", "%+", "a@b.c.@x.y", "1.2.3.4.5.6.7.8"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 12))) for _ in range(300)] + ["5" * 20000, "1 " * 8000, "a" * 30000, "a@b.co " * 3000]
    got = {r.doc_id: r for r in pii.report(documents(texts)).collect()}
    for d, t in enumerate(texts):
        want = base_spans(t)
        assert got[d].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:200]
        assert set(want) <= set(got[d].spans.split(",")) | {""}


def test_pii_labels_and_redaction(documents):
    texts = ["mail me: jo@site.org or card 4111111111111111", "the password = hunter2hunter2 ok", "order 12345 version 1.2.3", "call 269 555 3296 now"] * 5
    out = {r.doc_id: r.text for r in pii.redact(documents(texts)).collect()}
    assert out[0] == "mail me: <EMAIL> or card <CARD>" and out[2] == texts[2]
    assert "hunter2" not in out[1]
    weights = pii.fit([("email", (1, 1, 1), 1, 100), ("card", (0, 0, 0), 0, 500), ("card", (0, pii.ABSTAIN, pii.ABSTAIN), 1, 50)])
    assert weights["regex=1"] > weights["regex=0"]


def test_pii_finds_a_secret_of_letters_after_a_colon(documents):
    texts = ["password: correcthorsebattery", "no secret: here", "password: correcthorsebattery 1"] * 5
    got = {r.doc_id: r for r in pii.report(documents(texts)).collect()}
    assert got[0].spans == got[2].spans == "secret:0:29" and "secret" not in got[1].spans
    assert {r.doc_id: r.text for r in pii.redact(documents(texts)).collect()}[0] == "<SECRET>"


def test_syncmers(documents):
    texts = [t or "" for t in mixture(7)] + ["", "", "ab", "日本語のテキスト" * 20, "e" * 400]
    got = {r.doc_id: r for r in syncmers.fingerprints(documents(texts)).collect()}
    edited = []
    for d, t in enumerate(texts):
        e = t[: len(t) - len(t) // 4] + texts[(d + 1) % len(texts)][: len(t) // 4]
        edited.append(e)
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    whole = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(documents(edited)).collect()}
    assert all(whole[d] == got[d].edited_fingerprint for d in got)
    by_text = {}
    for d, t in enumerate(texts):
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    long = [d for d, t in enumerate(texts[:60]) if len(t) > 300 and texts[d] != texts[d + 1]]
    assert np.mean([got[d].near_edited > got[d].near_next for d in long]) > 0.9


def anchors_of(fingerprint):
    """Places and hashes of a fingerprint."""
    data, at, out = base64.b64decode(fingerprint, validate=True), 0, []
    for k in range(0, len(data), 9):
        at += data[k + 8]
        out.append((at, data[k : k + 8]))
    return out


def test_syncmers_keep_all_anchors(documents):
    """Long documents that share only a late passage, and one with repeated anchors: nothing is sampled."""
    rng = np.random.default_rng(9)
    made = lambda n: " ".join("".join(rng.choice(list("abcdfghiklmnoprstu"), 6)) for _ in range(n))
    shared = made(20)
    texts = [f"{made(1500)} {shared} {made(100)}", f"{made(900)} {shared}", "the same words again and " * 90, "the same words again and " * 30, "ab", ""]
    got = {r.doc_id: r for r in syncmers.fingerprints(documents(texts)).collect()}
    full = {d: anchors_of(r.fingerprint) for d, r in got.items()}
    assert len(full[0]) > 600 and [len(full[d]) for d in (4, 5)] == [1, 0]
    for d, r in got.items():
        symbols = re.findall(r"(?s)[^\se\u0250-\uffff]{0,15}.", texts[d])
        assert all(x < y <= x + syncmers.K for (x, _), (y, _) in zip(full[d], full[d][1:]))
        assert not full[d] or full[d][-1][0] + syncmers.K <= max(len(symbols), syncmers.K)
        for near, other in ((r.near_edited, anchors_of(r.edited_fingerprint)), (r.near_next, full[(d + 1) % len(texts)])):
            a, b = (collections.Counter(h for _, h in x) for x in (full[d], other))
            want = (a & b).total() / (a | b).total() if a or b else 1
            assert near == pytest.approx(want)
    assert 0 < got[0].near_next < 0.1


def spark_hash(values):
    """xxhash64 of a string, or of hashes one after another, as Spark chains them."""
    if isinstance(values, str):
        return xxhash.xxh64_intdigest(values.encode(), seed=42)
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), seed=seed)
    return seed


def test_syncmers_are_those_of_the_definition(documents):
    """Closed syncmers chosen one by one: the least of a k-mer's symbols, as signed numbers, stands at an end."""
    texts = [t for t in mixture(8, 24) if t] + ["日本語 and e " * 9, "abc", "x y z w"]
    got = {r.doc_id: r.fingerprint for r in syncmers.fingerprints(documents(texts)).collect()}
    for d, t in enumerate(texts):
        h = [spark_hash(x) for x in re.findall(r"(?s)[^\se\u0250-\uffff]{0,15}.", t)]
        signed = [x - (1 << 64) if x >> 63 else x for x in h]
        want = []
        for k in range(len(h) - syncmers.K + 1):
            window = signed[k : k + syncmers.K]
            if min(window[0], window[-1]) <= min(window[1:-1]):
                want.append((k, spark_hash(h[k : k + syncmers.K]).to_bytes(8, "big")))
        if len(h) < syncmers.K:
            want = [(0, spark_hash(t).to_bytes(8, "big"))]
        assert anchors_of(got[d]) == want, t[:80]


CLASHING = ("_id", "_spans", "_hit", "_bad", "_w", "_g", "_kept", "_digest", "_own", "key", "own", "other", "spans", "bad", "hit", "word", "gap", "row", "kept", "again", "digest", "salt", "rid", "w")


def test_columns_of_any_name_are_kept(spark, documents):
    """A table's other columns are its own, whatever they are called."""
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "item_id long, text string")
    docs = documents(["one two three here", "mail jo@site.org now", "one two three here", "clean"]).selectExpr("*", *(f"concat('{c}', doc_id) as `{c}`" for c in CLASHING))
    for name, out in (("cut", decontaminate.decontaminate(docs, bench, 3)), ("redact", pii.redact(docs)), ("dedup", near_dedup.without_near_duplicates(docs, 2))):
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in CLASHING), name
        assert {r.doc_id for r in rows} == ({0, 1, 3} if name == "dedup" else {0, 1, 2, 3})


def test_dedup_leaves_one_of_equal_rows(documents):
    """Rows that share an id, or have none, stand each for their own text."""
    a, b, c = ("alpha beta gamma delta epsilon " * 3, "other words that no text else has at all", "third text here with its own words in it")
    rows = [(1, a), (1, a), (2, b), (2, c), (None, c), (None, "a text without an id and without a twin"), (None, None), (None, None), (3, "x")]
    left = sorted((r.doc_id or 0, r.text or "") for r in near_dedup.without_near_duplicates(documents(rows)).collect())
    assert len([x for x in left if x[1] == a]) == 1 and len([x for x in left if x[1] == b]) == 1
    assert len([x for x in left if x[1] == c]) == 1 and len(left) == 6


def test_substring_dedup_keeps_rows_without_id_apart(documents):
    texts = [" ".join(f"{x}{k}" for k in range(30)) for x in "abc"]
    got = substring_dedup.substring_dedup(documents([(None, texts[0]), (None, texts[1]), (None, f"{texts[2]} {texts[1]}"), (5, texts[0])]), width_bits=18).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got)[-1] == (5, 30, 30)
    assert sum(r.n_removed for r in got if r.doc_id is None) == 30


def test_rows_without_an_id_are_judged_by_their_own_text(spark, documents):
    bench = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "item_id long, text string")
    texts = ["one two three four five six", "one two three and more", "clean words that must stay", "mail jo@site.org now and then", "clean words that must stay"]
    for key in (None, 7):
        docs = documents([(key, t) for t in texts])
        assert sorted(r.text for r in decontaminate.decontaminate(docs, bench, 3).collect()) == sorted(["and more", *texts[2:]])
        assert sorted(r.text for r in pii.redact(docs).collect()) == sorted([*texts[:3], "mail <EMAIL> now and then", texts[4]])
    found = syncmers.fingerprints(documents([(None, t) for t in texts])).collect()
    assert sorted(r.n_chars for r in found) == sorted(map(len, texts))


def test_url_rules(spark):
    urls = ["https://a.net/x", "http://EXAMPLE.net/en/1?q=2", "https://shop.example.com/de/3.html", "https://x.org/fr/", "https://notnet/x", None, "no scheme", "ftp://b.org/other#x", "https://example.com/en/4", "https://x.org", "https://y.net?z"]
    urls += [f"https://bad-ads{k}.net/promo/{k}" for k in range(30)] + [f"https://s{k}.org/fr/doc/{k}" for k in range(30)] + ["https://q.info/promo/7", "https://q.info/doc/7"]
    pages = spark.createDataFrame([(k, u, "<html>", "extra") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert len(got) == len(urls)
    assert [got[k].rule for k in range(11)] == ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, None, None, None, None, None, None]
    assert (got[1].host, got[1].path, got[1].verdict) == ("example.net", "/en/1", "allow")
    assert (got[5].host, got[5].path, got[9].path, got[10].path) == ("", "", "", "")
    assert got[len(urls) - 2].verdict == "block" and "promo" in got[len(urls) - 2].mined_rule
    assert got[len(urls) - 1].verdict == "allow"


def test_mined_rules_equal_brute_force(spark):
    """All antecedents by support and confidence, less those that a part with the same label makes needless; the surest decides."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(150):
        has = {t for t, chance in (("a", 0.5), ("b", 0.5), ("c", 0.4), ("d", 0.3), ("e", 0.2)) if rng.random() < chance}
        block = {"a", "b"} <= has or "e" in has or ({"b", "c", "d"} <= has and rng.random() < 0.9)
        rows.append((k, sorted(has), "block" if block else "allow"))
    frame = spark.createDataFrame(rows, "rid long, tokens array<string>, label string")
    found = {(frozenset(r.antecedent), r.label): (r.confidence, r.support) for r in url_rules.mine(frame, 0.05, 0.7).collect()}
    every = {}
    for size in range(1, 6):
        for part in itertools.combinations("abcde", size):
            for label in ("block", "allow"):
                with_part = [x for x in rows if set(part) <= set(x[1])]
                both = sum(x[2] == label for x in with_part)
                if both >= 0.05 * len(rows) and both / len(with_part) >= 0.7:
                    every[frozenset(part), label] = (both / len(with_part), both / len(rows))
    want = {k: v for k, v in every.items() if not any(o[1] == k[1] and o[0] < k[0] and every[o][0] >= v[0] for o in every)}
    assert found == {k: pytest.approx(v) for k, v in want.items()}
    for r in url_rules.match(frame, url_rules.mine(frame, 0.05, 0.7)).collect():
        fits = [(-v[0], -len(k[0]), -v[1], sorted(k[0]), k[1]) for k, v in want.items() if k[0] <= set(r.tokens)]
        assert r.mined == (min(fits)[4] if fits else None)


def test_urls_of_any_length_and_repeated(spark):
    urls = ["https://a.net/" + "x/" * 20000, "https://a.org/fr/1", "https://a.org/fr/1", None, None]
    got = url_rules.judge(spark.createDataFrame([(None if u is None else 7, u) for u in urls], "page_id long, url string")).collect()
    assert sorted((r.rule or "") for r in got) == ["", "", "net/", "org/fr/", "org/fr/"]


def test_url_rules_without_labels(spark):
    pages = spark.createDataFrame([(1, "https://a.com/"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in url_rules.judge(pages).collect()} == {"allow"}
