"""Each training-data operator against a brute-force version, and on awkward rows."""

import hashlib
import html
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, context_mix, decontaminate, fingerprint, html_text, mixing, order, pii, quality, set_join, url_filter
from tessera.llm.components import components

SF = "/root/testdata/sf0.001"
WORDS = "the and of that ther ation ing whe lyed onti erth inde stable ondor umlich été der wo".split()


def corpus(n=60, seed=3):
    """Texts with exact and near copies, nulls, empty and long ones."""
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 7 == 3 and rows:
            w = rows[int(r.integers(len(rows)))][1]
            w = (w or "").split(" ")
            if i % 2 and len(w) > 30:
                w[int(r.integers(len(w)))] = "changed"
            rows.append((i, " ".join(w)))
        else:
            k = int(r.integers(1, 120))
            rows.append((i, " ".join(str(r.choice(WORDS)) + str(r.integers(40)) for _ in range(k))))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "one two"), (n + 4, "One TWO"), (n + 5, "x" * 50_000), (n + 6, "a b c d e " * 3000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([(i, t, "en", None if i % 11 == 0 else f"s{i % 4}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def empty(df):
    return df.filter("false")


# 1


def brute_hits(text, items, size=10):
    w = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        iw = decontaminate.words_of(t)
        k = min(size, len(iw))
        if not k:
            continue
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    return len(w), len(hit), sorted(found)


def test_decontaminate(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    long = [t for _, t in rows if t and len(t.split()) > 40]
    items = [("1", " ".join(long[0].split()[5:30])), ("2", long[1].split()[7]), ("3", ""), ("4", "not there at all " * 6), ("10", long[0].upper().replace(" ", "-- ")), ("5", "a b c d e a b c d e a b")]
    bench = spark.createDataFrame([(int(i), t) for i, t in items] + [(99, None)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, keep=("doc_id", "text"), remove=True, shard_words=50).collect()}
    for i, t in rows:
        n, hit, found = brute_hits(t, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, found), i
        if not hit:
            assert got[i]["text_cut"] == t
        else:
            assert len(decontaminate.words_of(got[i]["text_cut"])) >= n - hit - len(got[i]["spans"])
    # In rounds, with clashing columns, and a phrase that stands at thousands of places.
    more = spark.createDataFrame([(i, t, "x", 1) for i, t in rows] + [(500, "hot word now " * 4000, "x", 1)], "doc_id long, text string, hit string, size int")
    hot = bench.union(spark.createDataFrame([(7, "hot word now")], "item_id long, text string"))
    once = {r["doc_id"]: tuple(r) for r in decontaminate.decontaminate(more, hot, keep=("doc_id", "hit"), shard_words=50).collect()}
    assert once == {r["doc_id"]: tuple(r) for r in decontaminate.decontaminate(more, hot, keep=("doc_id", "hit"), most_chars=200).collect()}
    assert once[500][2:5] == (12000, 12000, ["7"]) and all(once[i][2:4] == brute_hits(t, items)[:2] for i, t in rows)
    clash = decontaminate.decontaminate(docs.withColumn("n_words", F.lit("mine")), bench, keep=("doc_id", "N_words", "lang"))
    assert clash.columns[:3] == ["doc_id", "lang", "n_words"] and {r["doc_id"]: r["n_words"] for r in clash.collect()} == {i: brute_hits(t, items)[0] for i, t in rows}
    assert decontaminate.query(empty(docs), bench).count() == 0
    assert decontaminate.query(docs, empty(bench)).filter("contaminated").count() == 0


def test_fm_index():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 700):
        seq = np.concatenate(([0], r.integers(0, 4, n))).astype(np.int32)
        index = decontaminate.FMIndex(seq, 4, every=7)
        for k in (1, 2, 5):
            for w in {tuple(seq[i : i + k]) for i in range(0, len(seq) - k + 1, 3)}:
                lo, hi = index.find(np.array([w], np.int64))
                want = [i for i in range(len(seq) - k + 1) if tuple(seq[i : i + k]) == w]
                got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
                assert got == want


# 2


def test_context_mix(spark):
    r = np.random.default_rng(5)
    p = 1 / np.arange(1, len(WORDS) + 1)
    rows = [(i, " ".join(r.choice(WORDS, 80, p=p / p.sum())) + f" rare{i}zq") for i in range(300)] + [(300, None), (301, ""), (302, "A  b\n\n the and"), (302, "A  b\n\n the and"), (None, "the of")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int")
    got = [x.asDict() for x in context_mix.score_documents(df).collect()]
    assert len(got) == len(rows)
    import zlib

    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["<end>"]
    train = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(train.values()), len(train)
    want = {}
    for i, t in rows:
        w = tokens(t)
        want[i] = (held(i), len(w), sum(train[x] > 0 for x in w), n, sum(np.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    for g in got:
        w = want[g["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:4]
        assert g["base_score"] == pytest.approx(w[4], abs=1e-6)
        assert g["score"] < 0
    out = [g for g in got if g["held_out"] and g["n_tokens"] > 50]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)
    assert context_mix.score_documents(df.filter("false")).count() == 0


def test_context_mix_repeats(spark):
    """To the bit the same for other orders and partitions; chunks of any size count alike; rows that repeat are each scored."""
    rows = [(i, t) for i, t in corpus(80)] + [(5, "the same words again the same words again")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda d, **k: sorted((r["doc_id"], r["n_tokens"], r["score"]) for r in context_mix.score_documents(d, **k).collect())
    one = got(df)
    assert len(one) == len(rows) and one == got(df.orderBy(F.desc("doc_id")).repartition(5))
    small = {(r["doc_id"], r["n_tokens"]): (r["n_known"], r["train_tokens"], r["base_score"]) for r in context_mix.score_documents(df, chunk_chars=9000).collect()}
    whole = {(r["doc_id"], r["n_tokens"]): (r["n_known"], r["train_tokens"], r["base_score"]) for r in context_mix.score_documents(df).collect()}
    assert all(small[k][:2] == whole[k][:2] and small[k][2] == pytest.approx(whole[k][2]) for k in whole)


def placed_by_hand(counted):
    """Sizes of classes, and chunks' words with places from a plain sort of (class, partition)."""
    import pandas as pd

    sizes = pd.concat(list(context_mix.class_sizes([counted[counted["kind"] == 5]])))
    order = sizes.sort_values(["class", "p"])
    before = order["n"].cumsum() - order["n"]
    starts: dict = {}
    for p, c, start in zip(order["p"], order["class"], before):
        starts.setdefault(p, []).append({"class": c, "start": start})
    rows = counted[counted["kind"] == 2]
    return sizes, pd.concat(list(context_mix.placed_words([rows.assign(starts=[starts[p] for p in rows["p"]])])))


def test_places_of_words(spark):
    """Places follow the classes of counts, and no two words have one place."""
    import pandas as pd

    r = np.random.default_rng(7)
    texts = [" ".join("w" + str(k) for k in r.zipf(1.3, 200) % 500) for _ in range(40)]
    frame = lambda c: pd.DataFrame({"doc_id": [str(i) for i in range(c, 40, 4)], "text": texts[c::4], "fold": 1, "h": range(c, 40, 4), "chunk": c, "copies": 1})
    first = pd.concat([context_mix.first_pass(pd.concat(list(context_mix.packed_texts([frame(c)]))), 3) for c in range(4)])
    counted = pd.concat([context_mix.place_words(g) for _, g in first[first["kind"] == 1].groupby("p")])
    sizes, places = placed_by_hand(counted)
    got = context_mix.first_places(spark.createDataFrame(sizes, "p int, class int, n long, tokens long, words long"))
    given = {x["p"]: {y["class"]: y["start"] for y in x["starts"]} for x in got.collect()}
    order = sizes.sort_values(["class", "p"])
    assert all(given[p][c] == s for p, c, s in zip(order["p"], order["class"], order["n"].cumsum() - order["n"]))
    count, place = Counter(w for t in texts for w in [*t.split(), "\n"]), {}
    for c in range(4):
        body = context_mix.Body(pd.concat([first[(first["kind"] == 0) & (first["chunk"] == c)], places[places["chunk"] == c]]), 3)
        for w, p, n in zip(body.words, body.place, body.counts):
            assert count[w.decode()] == n and place.setdefault(w, p) == p
    known = {w: p for w, p in place.items() if p}
    assert sorted(known.values()) == list(range(1, len(known) + 1)) and all((count[w.decode()] > 1) == (p > 0) for w, p in place.items())
    ordered = [count[w.decode()] for w in sorted(known, key=known.get)]
    assert all(b <= a * 1.2 + 1 for a, b in zip(ordered, ordered[1:]))


def test_counts_over_chunks():
    """Keys, counts and states of the predictors are those of a plain count over all training texts, however texts are dealt to chunks."""
    import pandas as pd

    texts = [f"scarceword the and of the filler{i} spät" for i in range(9)] + ["the and of the and of"] * 3
    folds = [i % 4 for i in range(12)]

    def run(parts):
        frame = lambda c, p: pd.DataFrame({"doc_id": [str(i) for i in p], "text": [texts[i] for i in p], "fold": [folds[i] for i in p], "h": [i * 7919 % 100 for i in p], "chunk": c, "copies": 1})
        first = pd.concat([context_mix.first_pass(pd.concat(list(context_mix.packed_texts([frame(c, p)]))), 3) for c, p in enumerate(parts)])
        placed = pd.concat([context_mix.place_words(g) for _, g in first[first["kind"] == 1].groupby("p")])
        sizes, found = placed_by_hand(placed)
        known = pd.concat([first[first["kind"] == 0], found])
        keys = pd.concat([context_mix.second_pass(g, 3, 4) for _, g in known.groupby("chunk")])
        total = Counter()
        for _, r in keys.iterrows():
            k, c = context_mix.unpack(r["data"])
            total.update({(r["p"], x): int(n) for x, n in zip(context_mix.from_planes(k, np.uint64).tolist(), context_mix.from_bytes(c, np.uint32).tolist())})
        return sizes, {k: n for k, n in total.items() if n}, keys

    sizes, one, keys = run([range(12)])
    train = Counter(w for t, f in zip(texts, folds) if f for w in [*t.split(), "end"])
    assert (sizes["tokens"].sum(), sizes["words"].sum()) == (sum(train.values()), len(train))
    assert run([range(0, 12, 2), range(1, 12, 2)])[1] == one and run([[i] for i in range(12)])[1] == one
    for p, g in keys.groupby("p"):
        k, c = context_mix.unpack(g["data"].iloc[0])
        k, c = context_mix.from_planes(k, np.uint64), context_mix.from_bytes(c, np.uint32).astype(np.int64)
        full, less = context_mix.path_states(k, c)
        for i in range(0, len(k), 7):
            for d in range(8):
                n = [sum(int(y) for x, y in zip(k.tolist(), c.tolist()) if x >> (8 - d) == int(k[i]) >> (8 - d) and x >> (7 - d) & 1 == b) for b in (0, 1)]
                own = int(k[i]) >> (7 - d) & 1
                assert full[d, i] == context_mix.state_of(np.array([n[0]]), np.array([n[1]]))[0]
                n[own] = max(0, n[own] - 1)
                assert less[d, i] == context_mix.state_of(np.array([n[0]]), np.array([n[1]]))[0]


def test_bits_are_a_distribution():
    """The chances of all values of a symbol add up to one, and mirrored states predict the other bit."""
    r = np.random.default_rng(4)
    mixer = context_mix.Mixer()
    n = 20_000
    states = [r.integers(0, context_mix.STATES, n) for _ in range(context_mix.CONTEXTS)]
    kind = r.integers(0, 3, n)
    mixer.see(states, kind, r.integers(0, 2, n), np.ones(n))
    mixer.fit()
    keys = np.arange(256, dtype=np.uint64)
    tables = [context_mix.path_states(keys, (r.integers(0, 5, 256) * r.integers(0, 2, 256) * 40**k % 5000).astype(np.int64))[0] for k in range(context_mix.CONTEXTS)]
    for q in range(3):
        p = np.ones(256)
        for d in range(8):
            one = mixer.chance([t[d] for t in tables], np.full(256, q))
            p *= np.where(keys >> np.uint64(7 - d) & np.uint64(1) == 1, one, 1 - one)
        assert p.sum() == pytest.approx(1, abs=1e-5) and p.min() > 0
    a, b = r.integers(0, 300, 500), r.integers(0, 300, 500)
    assert (context_mix.mirrored()[context_mix.state_of(a, b)] == context_mix.state_of(b, a)).all()


def test_codes_are_a_prefix_code():
    """Different words have different codes, and no code begins another."""
    words = [f"w{i}".encode() for i in range(3000)] + [b"spelled", b"spelt", "sp\u00e4t".encode()]
    place = np.concatenate((np.arange(1, 3001) ** 2 % 8_999_993 + 1, [0, 0, 0]))
    c = context_mix.Codes(words, place)
    codes = set()
    for i in range(len(words)):
        rows = [(c.value[i], c.bits[i])] + [(c.more_value[k], c.more_bits[k]) for k in range(c.start[i], c.start[i] + c.count[i])]
        codes.add("".join(f"{int(v):08b}"[:b] for v, b in rows))
    ordered = sorted(codes)
    assert len(codes) == len(set(place.tolist())) + 2
    assert not any(b.startswith(a) for a, b in zip(ordered, ordered[1:]))


def test_guesses_come_from_the_same_text():
    import pandas as pd

    texts = ["a b c a b c a b d", "a b x", "c c c c c"]
    frame = pd.DataFrame({"doc_id": ["1", "2", "3"], "text": texts, "fold": [1, 2, 3], "h": [1, 2, 3], "chunk": 0, "copies": 1})
    first = context_mix.first_pass(pd.concat(list(context_mix.packed_texts([frame]))), 1)
    body = context_mix.Body(pd.concat([first[first["kind"] == 0], placed_by_hand(context_mix.place_words(first[first["kind"] == 1]))[1]]), 1)
    s = context_mix.Symbols(body)
    got, at = [], 0
    for t in texts:
        w, seen = [x.encode() for x in t.split()] + [context_mix.END], {}
        for i, x in enumerate(w):
            assert body.words[body.tokens[at]] == x
            want = seen.get(tuple(w[i - 2 : i])) if i > 1 else None
            got.append((None if s.guess[at] < 0 else body.words[s.guess[at]]) == want)
            if i > 1:
                seen[tuple(w[i - 2 : i])] = x
            at += 1
    assert all(got)


def test_weights_learn():
    """Where one predictor is right and the others are noise, the mix comes near to it."""
    r = np.random.default_rng(8)
    n, mixer = 50_000, context_mix.Mixer()
    bit = r.integers(0, 2, n)
    good = np.where(r.random(n) < 0.9, bit, 1 - bit) * len(context_mix.ALONE) + 5
    states, kind = [r.integers(1, context_mix.STATES, n), good, r.integers(1, context_mix.STATES, n)], np.zeros(n, np.int64)
    mixer.see(states, kind, bit, np.ones(n))
    p = mixer.fit().chance(states, kind)
    loss = -np.log2(np.where(bit == 1, p, 1 - p)).mean()
    assert loss < 0.469 * 1.05  # the entropy of 0.9


# 3


def test_fingerprints(spark, docs):
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in fingerprint.query(docs).collect()}
    weights = lambda t: Counter(w for w in re.split(r"[ \t-\r]+", t) if w)
    errors = []
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        assert got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[d]["n_chars"] == len(t)
        a, b = weights(t), weights(edited)
        if a or b:
            errors.append(got[d]["near_edited"] - sum((a & b).values()) / sum((a | b).values()))
    assert abs(np.mean(errors)) < 0.05 and np.std(errors) < 0.15
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]
    assert fingerprint.query(empty(docs)).count() == 0
    one = fingerprint.query(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_fingerprints_of_repeated_rows(spark):
    """Null and repeated ids, equal rows: every row stays, and equal rows follow each other."""
    rows = [(None, "a b c d"), (None, "a b c d"), (1, "x y z w v"), (1, "other text of one id"), (1, "other text of one id"), (1, "other text of one id"), (2, None), (None, "e f g h")]
    got = [r.asDict() for r in fingerprint.query(spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, n string")).collect()]
    assert Counter((g["doc_id"], g["n_chars"]) for g in got) == Counter((i, len(t or "")) for i, t in rows)
    same = [g for g in got if g["n_chars"] == 20]
    assert [g["near_next"] == 1 for g in same].count(True) >= 2
    assert sum(g["edited_sha256"] == hashlib.sha256(("other text of o" + "other").encode()).hexdigest() for g in same) == 2


def test_with_next(spark):
    values = [(int(i) ** 3 - 5, i) for i in np.random.default_rng(0).permutation(200).tolist()] + [(7, 900 + i) for i in range(60)] + [(None, 5), (None, 6)]
    ids = spark.createDataFrame(values, "k long, x long")
    rows = {(r["k"], r["x"]): (r["next_k"], r["next_x"]) for r in order.with_next(ids, "k", "x").collect()}
    s = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert rows == {a: b for a, b in zip(s, s[1:] + s[:1])} and len(rows) == 262
    assert order.with_next(ids.filter("false"), "k", "x").count() == 0


# 4


def test_chat(spark):
    turns = [(1, 0, "system", "be <|im_end|>\n<\\|x"), (1, 1, "user", None), (1, 2, "assistant", "\n\\<|im_start|>user\n"), (2, 0, "assistant", "first"), (2, 1, "assistant", ""), (3, None, None, "odd"), (3, 5, "to\nol\\n<|", "x" * 20_000), (None, 0, "user", "u"), (None, 1, "assistant", "a<"), (4, 0, "user", "same"), (4, 0, "user", "same")]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(chat.with_hard_case(df))).collect()}
    for c in {t[0] for t in turns} | {-1}:
        mine = sorted(([t for t in turns if t[0] == c] or [(-1, i, r, chat.HARD) for i, r in enumerate(("user", "assistant"))]), key=lambda t: -1 if t[1] is None else t[1])
        assert [(x["role"], x["text"]) for x in got[c]["turns"]] == [(t[2] or "", t[3] or "") for t in mine]
        assert got[c]["loss_text"] == "".join(t[3] or "" for t in mine if t[2] == "assistant")
    assert got[1]["valid"] and not got[2]["valid"] and got[2]["first_error"] == 1 and not got[3]["valid"] and got[-1]["valid"] and not got[4]["valid"]
    assert chat.format_chats(empty(df)).count() == 0
    many = spark.createDataFrame([(9, i, "user" if i % 2 == 0 else "assistant", f"text {i} " * (i % 5)) for i in range(500)], "conv_id long, turn long, role string, text string")
    long = chat.read_chats(chat.format_chats(many)).first()
    assert long["loss_text"] == "".join(f"text {i} " * (i % 5) for i in range(1, 500, 2)) and long["valid"] and len(long["turns"]) == 500


# 5


def test_quality(spark):
    r = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(600):
        kind = i % 4
        w = list(r.choice(WORDS, 60))
        if kind == 1:
            w[5] = w[30] = "moronic"
        if kind == 2:
            w = [x + "***" for x in w]
        if kind == 3:
            w = ["moronic***" if j % 9 == 0 else x + "***" for j, x in enumerate(w)]
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(kind in (0, 1)), int(kind in (1, 3))))
    labels += [(0, None, 1), (None, 1, 0)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.query(docs, lab).collect()}
    assert len(got) == 602
    right = [got[i]["accepted"] == (i % 4 == 0) for i in range(400, 600)]
    assert np.mean(right) > 0.97
    grade = lambda k: np.mean([got[i]["expected_grade"] for i in range(400, 600) if i % 4 == k])
    assert grade(0) > grade(2) > max(grade(1), grade(3))
    assert all(g["p_ge_1"] >= g["p_ge_2"] for g in got.values())
    assert quality.query(docs, empty(lab)).count() == 602 and quality.query(empty(docs), lab).count() == 0


def test_cumulative_link_gradient():
    """Gradients against differences of the loss; probabilities against their definition."""
    r = np.random.default_rng(6)
    rows = [np.unique(r.integers(0, 30, int(r.integers(0, 12)))) for _ in range(40)]
    grades = r.integers(0, 4, 40)
    x = quality.Rows(rows, np.arange(30), 30)
    params = [r.normal(size=30) * 0.3, np.array([-0.7]), np.array([0.2, -0.4])]
    value, grads = quality.loss(x, grades, *params, 0.5)
    cuts = quality.thresholds(*params[1:])
    s = [10 / max(1, len(f)) ** 0.5 * params[0][f].sum() for f in rows]
    cdf = lambda k, v: 0.0 if k < 0 else 1.0 if k >= 3 else 1 / (1 + np.exp(v - cuts[k]))
    want = -sum(np.log(cdf(g, v) - cdf(g - 1, v)) for g, v in zip(grades, s)) + 0.25 * (params[0] ** 2).sum() + 0.05 * (params[1] ** 2).sum() + 0.05 * (params[2] ** 2).sum()
    assert value == pytest.approx(want) and (np.diff(cuts) > 0).all()
    for i, p in enumerate(params):
        for j in range(len(p)):
            up, down = [q.copy() for q in params], [q.copy() for q in params]
            up[i][j] += 1e-5
            down[i][j] -= 1e-5
            assert grads[i][j] == pytest.approx((quality.loss(x, grades, *up, 0.5)[0] - quality.loss(x, grades, *down, 0.5)[0]) / 2e-5, abs=1e-4)
    tails = quality.CumulativeLink(params[0], cuts).tails(np.array(s))
    assert np.allclose(tails, [[1 - cdf(k, v) for k in range(3)] for v in s])


def test_quality_awkward(spark):
    """Labels out of range, repeated documents and ratings, clashing names, a bound on the sample."""
    docs = spark.createDataFrame([(i, f"word{i % 3} good text of all", 1.0, i) for i in range(40)] + [(1, "word1 good text of all", 1.0, 1)] * 500 + [(None, "none", 2.0, 1)], "doc_id long, text string, score double, h long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(5, 7, 0), (6, 1, -3), (7, None, None)] + [(8, 0, 1)] * 3, "doc_id long, quality int, toxic int")
    assert quality.labelled(docs, labels, 10).select("doc_id", "h", "grade").distinct().count() == 10
    assert quality.labelled(docs, labels).select("doc_id", "h", "grade").distinct().count() == 31
    model = quality.train(docs, labels)
    got = quality.score(docs, model, keep=("doc_id", "Score", "h"))
    assert got.columns == ["doc_id", "h", "score", "expected_grade", "p_ge_1", "p_ge_2", "accepted"] and got.count() == 541


# 6

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">menu one</a></li><li><a href="/b">menu two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site, and so on and so forth.</p></div><div class="ad">Buy this now.</div>
<article><h1>Head &amp; line</h1><p>First paragraph of the main text, which is long
   enough, with a <a href="x">link</a> in it.<p>Second&nbsp;one &copy; &#x41;&#66;.<ul><li>item one<li>item two</ul>
<form><input><button>Send</button></form><p>Short.</p><!-- note --><div class="comments"><p>A reader wrote a very long comment about all this, far longer than any paragraph.</p></div></article>
<aside>Read also</aside><footer>&copy; all rights</footer></body></html>"""


def test_html(spark):
    want = ["Head & line", "First paragraph of the main text, which is long enough, with a link in it.", "Second one © AB.", "item one", "item two", "Short."]
    assert html_text.main_text(PAGE).split("\n\n") == want
    for cut in range(0, len(PAGE), 7):
        html_text.main_text(PAGE[:cut])
    pages = [(1, "u", PAGE), (2, None, None), (3, "", ""), (4, "x", "plain text"), (5, "x", "<p>" * 3000 + "deep"), (6, "y", '<a "unclosed <b>text'), (1, "u", PAGE)]
    df = spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_text.query(df).collect()}
    assert got[1]["text"] == "\n\n".join(want) and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] == "" and got[4]["text"] == "plain text" and got[5]["text"] == "deep"
    assert html_text.query(empty(df)).count() == 0


def article_of(page):
    """What lies between article tags, by patterns alone."""
    inner = re.search(r"(?s)<article[^>]*>(.*)</article>", page)[1]
    parts = re.split(r"</?(?:p|h1|ul|li|div|article)\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br[^>]*>", " ", x))).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


def test_html_all_pages():
    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if x]
    assert all(html_text.main_text(x) == article_of(x) for x in pages)


def test_html_density_decides(monkeypatch):
    """Pages without landmarks, class names or article: the text is found by density alone, and not found without it."""
    import pyarrow.parquet as pq

    pages = [x for x in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist() if x and len(article_of(x)) > 1000]
    bare = [re.sub(r"(</?)(?:nav|article|footer)\b", r"\1div", x.replace(' class="ad"', "")) for x in pages]
    right = lambda: np.mean([html_text.main_text(b) == article_of(x) for b, x in zip(bare, pages)])
    assert len(pages) > 60 and right() > 0.95
    monkeypatch.setattr(html_text, "densities", lambda root, order: None)
    assert right() == 0


def test_html_marks():
    """A mark on a paragraph or on what holds the main text says nothing; formulas are text; a marked part beside it goes."""
    text = "".join(f"<p>Paragraph {i} of the main text, long enough to be one, with nothing else in it.</p>" for i in range(6))
    want = re.findall(r"<p>(.*?)</p>", text)
    get = lambda x: html_text.main_text(x).split("\n\n")
    assert get(f"<body><form action=x>{text}<button>Go</button></form></body>") == want
    assert get(f'<body><div class="social header"><div>{text}</div></div><div class="comments"><p>Nice one, thank you very much for that text.</p></div></body>') == want
    assert get(f'<body><div><p class="entry-header">Top line of it all, in words.</p>{text}<p id="share-price">The price of a share was <math><mi>x</mi></math> then.</p></div></body>') == ["Top line of it all, in words.", *want, "The price of a share was x then."]
    comments = "".join(f"<p>Reader {i} says that this is a long and good text about nothing at all.</p>" for i in range(9))
    assert get(f'<body><div id=main><h1>Title of the page</h1>{text}<div class="comments">{comments}</div></div></body>') == ["Title of the page", *want]
    assert get(f"<body><div><a href=1>one link</a> <a href=2>two links</a></div><h1>Title of the page</h1><div>{text}</div><div>{text}</div></body>") == ["Title of the page", *want, *want]


# 7


def test_urls(spark):
    urls = ["http://www.Spam-Farm.example.org/fr/1", "https://a.org/es/x", "http://example.org/es/2", "http://m.example.org/en/12?x", "http://x.com/fr/9#t", "http://x.com/de/", "no scheme", None, "http://org", "http://org/", "ads-track.example.com://x", "http://ads-track.example.com", "https://casino-win.example.net/en/1", "http:///p", "http://h.net?a/b"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge_urls(df, url_filter.listed_sites(spark)).collect()}
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
    for i, u in enumerate(urls + urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(r), r, v) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        site = next((s for s in url_filter.LISTED_SITES if host == s or host.endswith("." + s)), None)
        want = (host, path, max(fit)[1], max(fit)[2], site) if fit else (host, path, None, "block" if site else "allow", site)
        assert got[i] == want, u
    assert url_filter.judge_urls(empty(df), url_filter.listed_sites(spark)).count() == 0
    clash = url_filter.judge_urls(df, url_filter.listed_sites(spark), keep=("page_id", "Host"), most_bytes=8)
    assert clash.columns == ["page_id", "host", "path", "rule", "verdict", "listed_site"] and {r["page_id"]: tuple(r)[1:] for r in clash.collect()} == got


def test_cascade(spark):
    universe = spark.range(5000).selectExpr("concat('k', id) key").union(spark.createDataFrame([(None,)], "key string"))
    listed = spark.range(0, 9000, 7).selectExpr("concat('k', id) key")
    c = url_filter.build_cascade(universe, listed)
    wrong = universe.filter("key is not null").filter(c.listed(F.col("key")) != (F.substring("key", 2, 9).cast("int") % 7 == 0)).count()
    assert wrong == 0 and len(c.levels) > 1
    assert not url_filter.build_cascade(universe, listed.filter("false")).levels


# 8


def brute_components(rows, words, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    comp = {i: i for i in sets}
    ids = sorted(sets)
    changed = True
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            if comp[a] != low or comp[b] != low:
                comp[a] = comp[b] = low
                changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def chain_rows():
    """A chain in which each text links with the next only, groups of near copies, and a passage shared by texts that do not link."""
    r = np.random.default_rng(9)
    word = lambda: "w" + str(r.integers(10**6))
    rows, base = [], [word() for _ in range(100)]
    for i in range(12):
        rows.append((100 - i, " ".join(base)))
        k = (i * 17) % 90
        base = base[:k] + [word(), word()] + base[k + 2 :]
    shared = [word() for _ in range(40)]
    rows += [(200 + i, " ".join(shared + [word() for _ in range(12)])) for i in range(30)]
    hot = [word() for _ in range(60)]
    for i in range(60):
        w = list(hot)
        w[int(r.integers(60))] = word()
        rows.append((300 + i, " ".join(w)))
    return rows + corpus(40)


@pytest.mark.parametrize("rule", [set_join.Rule(), set_join.Rule(words=5, num=80)])
def test_set_join(spark, rule):
    rows = chain_rows()
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.link_documents(df, rule).collect()}
    assert got == brute_components(rows, rule.words, rule.num, rule.den)


def test_set_join_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "a b c d e"), (3, "A B C D E"), (None, "a b c d e"), (7, None), (8, "")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in set_join.query(df).collect()) == [(0, 3), (3, 3), (5, 3), (5, 3), (7, 7), (8, 8)]
    assert set_join.query(empty(df)).count() == 0


def test_set_join_rows(spark, monkeypatch):
    """Neither a passage that few texts of a task hold nor a large group of near copies fills the token-group matrix."""
    r, held, keep = np.random.default_rng(5), {}, set_join.written
    word = lambda: "w" + str(r.integers(10**6))

    def written(df, name):
        held[name] = keep(df, name)
        return held[name]

    monkeypatch.setattr(set_join, "written", written)
    shared, base = [word() for _ in range(40)], [word() for _ in range(400)]
    rows = [(1000 + i, " ".join(shared + [word() for _ in range(60)])) for i in range(24)]
    for i in range(200):
        w = list(base)
        for k in r.integers(0, 400, 10):
            w[k] = word()
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(32)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.link_documents(df).collect()}
    assert got == brute_components(rows, 4, 85, 100)
    assert held["sets"].filter("n > 200").select("g").distinct().count() <= 2
    assert held["matrix"].filter("n < 200").count() == 0


def test_set_join_half_alike(spark, monkeypatch):
    """Texts that share a part with one other do not meet the matrix, and few of them are held against each other, though no order puts their part last."""
    r, held, keep = np.random.default_rng(11), {}, set_join.written

    def written(df, name):
        held[name] = keep(df, name)
        return held[name]

    words = lambda n: ["w" + str(r.integers(10**6)) for _ in range(n)]
    monkeypatch.setattr(set_join, "written", written)
    monkeypatch.setattr(set_join, "_levels", lambda docs, rule: np.zeros((1 << set_join.PLACES) // 2, np.uint8))
    rows = []
    for i in range(60):
        part = words(120)
        rows += [(2 * i + k, " ".join(part + words(180))) for k in (0, 1)]
    for i in range(6):
        base = words(300)
        near = [base[:k] + words(1) + base[k + 1 :] for k in r.integers(0, 300, 4)]
        rows += [(1000 + 10 * i + k, " ".join(w)) for k, w in enumerate([*near, base[:130] + words(170)])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in set_join.link_documents(df).collect()}
    assert got == brute_components(rows, 4, 85, 100)
    assert held["qualifying"].count() <= 6
    assert held["matrix"].count() <= 1500


@pytest.mark.parametrize("rule", [set_join.Rule(), set_join.Rule(words=5, num=80)])
def test_may_link(spark, rule):
    """The least hits of prefixes that sets which link can have, by size, are never ruled out."""
    rows = []
    for n in [*range(1, 60), 99, 100, 101, 380, 1000, 3777]:
        for m in {*range(max(1, rule.num * n // rule.den - 1), min(n + 40, rule.den * n // rule.num + 2)), rule.den * n // rule.num}:
            common = -(-rule.num * (n + m) // (rule.num + rule.den))
            if rule.num * max(n, m) <= rule.den * min(n, m):
                rows.append((n, m, common - max(n - rule.prefix(n), m - rule.prefix(m))))
    df = spark.createDataFrame(rows, "n long, m long, hits long")
    assert df.filter(~rule.may_link(F.col("n"), F.col("m"), F.col("m"), F.col("hits"))).count() == 0
    assert df.filter(~rule.may_link(F.col("n"), F.col("m") - 3, F.col("m") + 5, F.col("hits"))).count() == 0
    assert df.filter(rule.may_link(F.col("n"), 2 * F.col("n"), 3 * F.col("n"), F.col("n"))).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["v"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[k] == 100 for k in range(100, 140)) and got[201] == 200


# 9

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def good(k, v):
        d = re.sub("[^0-9]", "", v)
        if k == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if k == "phone":
            return 8 <= len(d) <= 15
        if k == "card":
            return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return True

    return {k: [m.span() for m in re.finditer(p, text or "") if good(k, m[0])] for k, p in PATTERNS.items()}


def test_pii(spark):
    texts = [
        "mail a.b@c.de, x@y.z_d@e.f and +49 (0) 123-456 789 or 4111 1111 1111 1111", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3", "é𝔸@b.c a@b.c. é a@b..c +1", None, "", "4111111111111111 4111-1111-1111-1112 1 2 3",
        "1 " * 5000, "a" * 60_000 + "@", "@" * 1000 + "a@a.a" * 200, "+" * 500 + "1" * 20 + "+12 34 56 78", "1.1.1.1" * 50, "9" * 30_000, "+1((((((((((" * 100,
    ]
    near = [f"text {i} of zebrafish secretname pal@corp.example end number{i}" for i in range(5)] + [f"plain zebra text {i} zzzz" for i in range(40)]
    rows = [(i, t, 0) for i, t in enumerate(texts + near)] + [(0, texts[0], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, card long")
    got = {r["doc_id"]: r for r in pii.query(df).collect()}
    for i, t, _ in rows:
        want = brute_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in want[k]).encode()).hexdigest(), t and t[:60]
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [len(want[k]) for k in PATTERNS]
        assert got[i]["n_found"] == sum(map(len, want.values())) + got[i]["n_secret"] and got[i]["n_term"] == got[i]["spans"].count("term:")
    n = len(texts)
    at = near[0].index("secretname")
    assert f"term:{at}:{at + 10}" in got[n]["spans"] and "term" not in got[n + 10]["spans"]
    new = {r["doc_id"]: r["new"] for r in pii.sanitise(df, keep=("doc_id", "text")).withColumn("new", pii.rewrite(F.col("text"))).select("doc_id", "new").collect()}
    assert new[0] == "mail [EMAIL], [EMAIL][EMAIL] and [PHONE] or [CARD]" and new[3] is None and "secretname" not in new[n] and new[n + 10] == near[10 - 0]
    assert pii.query(empty(df)).count() == 0


def test_disclosure_of_few_texts(spark):
    """A value of one text, of two, and of exact copies."""
    texts = ["text of uniqueterm only@one.example"] + [f"text of pairterm two@two.example {i}" for i in range(2)] + ["text of copyterm copy@copy.example"] * 40
    texts += [f"text of plain words {i}" for i in range(3000 - len(texts))]
    got = {r["doc_id"]: r["term"] for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("doc_id < 60").collect()}
    for i, term in ((0, "uniqueterm"), (1, "pairterm"), (2, "pairterm"), (3, "copyterm"), (42, "copyterm")):
        assert [(t["start"], t["end"]) for t in got[i]] == [(8, 8 + len(term))]
    assert got[0][0]["action"] == "generalise" and got[3][0]["action"] == "remove" and not got[43]


def test_disclosure_over_whole_documents(spark):
    """Terms far from their value, and in a text without it."""
    filler = " ".join(["plain words that every text holds"] * 5)
    one = f"only@one.example {filler} Uniqueterm {filler} éuniqueterm uniqueterm2 UNIQUETERM"
    two = [f"two@two.example {filler} pairterm {i}" for i in range(2)]
    copies = [f"copy@copy.example {filler} copyterm"] * 40
    texts = [one, *two, *copies, *[f"home@home.example {filler} manyterm {i}" for i in range(60)], f"no value here but manyterm {filler}"]
    texts += [f"{filler} {i}" for i in range(3000 - len(texts))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["term"] for r in pii.sanitise(df).filter("doc_id < 120").collect()}
    # éuniqueterm is another word, which stands in this text alone too.
    spans = lambda i, w: [(m.start(), m.end()) for m in re.finditer(rf"(?i)(?<![^\W\d_])(?:{w})(?![^\W\d_])", texts[i])]
    at = lambda i: [(t["start"], t["end"]) for t in got[i]]
    assert at(0) == spans(0, "uniqueterm|éuniqueterm") and len(at(0)) == 4 and at(0)[0][0] > 64
    assert at(1) == spans(1, "pairterm") and at(2) == spans(2, "pairterm") and len(at(1)) == 1
    assert at(3) == spans(3, "copyterm") and len(at(3)) == 1 and {t["action"] for t in got[3]} == {"remove"}
    without = next(i for i, t in enumerate(texts) if t.startswith("no value"))
    assert spans(without, "manyterm")[0] in at(without)
    assert not got[without + 1]


def test_disclosure_by_brute_force(spark):
    """Every term's span and action from counts made in plain Python."""
    r = np.random.default_rng(11)
    vocabulary = ["".join(r.choice(list("abdelmnorst"), int(r.integers(3, 8)))) for _ in range(400)]
    p = 1 / np.arange(1, 401)
    values = [f"user{k}@site.example" for k in range(30)] + ["tok" + "9f8e7d6c5b4a" * 3]
    texts = []
    for i in range(400):
        w = list(r.choice(vocabulary, int(r.integers(3, 40)), p=p / p.sum()))
        for _ in range(int(r.integers(0, 3)) if i % 3 == 0 else 0):
            k = int(r.integers(len(values)))
            w.insert(int(r.integers(len(w))), values[k])
            w.insert(int(r.integers(len(w))), "friend" + chr(97 + k % 26) * (2 + k // 26))
        texts.append(" ".join(w).capitalize() if i % 5 else " ".join(w))
    base = [brute_spans(t) | {"secret": [m.span() for m in re.finditer(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{24,}", t)]} for t in texts]
    of = lambda i: {(k, texts[i][a:b].lower()) for k in base[i] for a, b in base[i][k]}
    word = re.compile(r"[^\W\d_]{4,}")
    n_t, n_v, n_vt = Counter(), Counter(), Counter()
    for i, t in enumerate(texts):
        inside = [s for k in base[i] for s in base[i][k]]
        n_t.update({m[0].lower() for m in word.finditer(t)})
        n_v.update(of(i))
        outside = {m[0].lower() for m in word.finditer(t) if not any(a < m.end() and m.start() < b for a, b in inside)}
        n_vt.update((v, x) for v in of(i) for x in outside)
    level, least = Counter(), {}
    for (v, x), n in n_vt.items():
        p_v = n_v[v] / len(texts)
        hidden = -np.log2((n + p_v) / (n_t[x] + 1))
        if hidden <= min(1.0, 0.1 * -np.log2(p_v)):
            least[x] = min(hidden, least.get(x, 9))
        level[x] = max(level[x], 2 if hidden <= min(0.1, 0.02 * -np.log2(p_v)) else 1 if hidden <= min(1.0, 0.1 * -np.log2(p_v)) else 0)
    got = {x["doc_id"]: x for x in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = 0
    for i, t in enumerate(texts):
        inside = [s for k in base[i] for s in base[i][k]]
        free = [m for m in word.finditer(t) if not any(a < m.end() and m.start() < b for a, b in inside)]
        want = [(m.start(), m.end(), "remove" if level[m[0].lower()] == 2 else "generalise") for m in free if level[m[0].lower()] and (inside or least[m[0].lower()] <= 0.5)]
        assert [tuple(x) for x in got[i]["term"]] == want, t
        assert [(x["start"], x["end"]) for x in got[i]["secret"]] == base[i]["secret"]
        found += len(want)
    assert found > 5


def test_many_values_in_one_text(spark):
    """Thousands of matches, more than one fold holds; null ids, and columns that clash with inner names."""
    text = " ".join(f"w{i} a{i}@b.c +49 {10_000_000 + i}" for i in range(3000))
    df = spark.createDataFrame([(None, text, "x"), (None, None, "y"), (1, "", "z")], "doc_id long, text string, pii_text string")
    rows = pii.sanitise(df, keep=("doc_id", "text", "pii_text")).withColumn("new", pii.rewrite(F.col("text"))).collect()
    assert len(rows) == 3 and {r["pii_text"] for r in rows} == {"x", "y", "z"}
    big = next(r for r in rows if r["n_chars"])
    assert [(x["start"], x["end"]) for x in big["email"]] == brute_spans(text)["email"] and len(big["phone"]) == 3000
    assert big["new"] == " ".join(f"w{i} [EMAIL] [PHONE]" for i in range(3000))


# 10


def test_mixing(spark, docs):
    got = mixing.mix_sources(docs, keep=("doc_id", "source", "text")).collect()
    assert len(got) == docs.count()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for r in got:
        assert r["size"] == size(r["text"]) and 0 <= r["taken"] <= 2 * r["size"]
        per[r["source"]] += r["size"]
    names = sorted((s for s in per if s is not None)) + [None]
    weight = dict(zip(names, [5, 2, 1] * 9))
    target, full, left = {}, set(), 1.5 * sum(per.values())
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level > 2 * per[s]]
        if not over:
            target.update({s: weight[s] * level for s in open_})
            break
        for s in over:
            target[s] = 2 * per[s]
            left -= 2 * per[s]
            full.add(s)
    taken = Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == per[r["source"]]
        taken[r["source"]] += r["taken"]
    assert sum(taken.values()) == pytest.approx(sum(target.values()), abs=1)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}
    assert mixing.mix_sources(empty(docs)).count() == 0


def test_mixing_repeated_rows(spark, docs):
    """Equal ids with other texts, equal rows, null ids and ties: every row stays, sums hold, and other partitions give the same rows."""
    rows = [(1, "a b c", "s")] * 40 + [(1, "d e", "s"), (1, None, "s"), (None, "x y z w", None), (None, "x y z", "t"), (2, "a b c", "t"), (3, "a b c", "s")] * 3
    df = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, source string, size int")
    take = lambda d: sorted((str(r["doc_id"]), str(r["text"]), r["taken"], r["size"]) for r in mixing.mix_sources(d, keep=("doc_id", "text", "size")).collect())
    got = take(df)
    assert len(got) == len(rows) and got == take(df.orderBy("text").repartition(3))
    per = Counter()
    for _, t, s in rows:
        per[s] += len((t or "").split())
    targets = {r["source"]: r["target"] for r in mixing.mix_sources(df, keep=("source",)).collect()}
    assert sum(x[2] for x in got) == int(sum(targets.values())) and all(x[2] <= 2 * x[3] for x in got)
    assert set(targets) == set(per) and mixing.mix_sources(empty(df)).count() == 0
