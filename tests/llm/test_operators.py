import json
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import classifier, common, decontaminate, html_extract, near_dup, packing, pii, quality_rules, substring_dedup, tokens, url_filter
from foliant.llm.queries import tokenizer_path
from tests.llm import helpers as h

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def rows():
    return h.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return h.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return h.frame(spark, [])


def clash(df):
    """df with extra columns that are named like results."""
    return df.withColumns({c: F.lit("x") for c in ("n", "n_words", "start", "kept", "a", "b", "v", "h", "score", "base", "spans", "rank", "component_id", "_salt", "_runs", "_found", "_statistics", "more", "found", "hot", "x", "s", "doc", "digest", "item_id")})


# 1


def test_quality_rules(spark, rows, docs, empty):
    plan = quality_rules.plan_cascade(docs)
    assert {r.name for r in plan.rules} == {r.name for r in quality_rules.METHOD_RULES}
    feats = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.apply_cascade(clash(docs), plan, quality_rules.BASE_RULES, feats).collect()
    assert len(got) == len(rows)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        w = h.WORD.findall(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), h.repeated_words(w))
        assert r.gate_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w)) and (r.kept or r.rejected_by)
    flipped = quality_rules.Cascade(plan.rules[::-1], ())
    assert {r.doc_id: r.kept for r in quality_rules.apply_cascade(docs, flipped).collect()} == {r.doc_id: r.kept for r in quality_rules.apply_cascade(docs, plan).collect()}
    assert quality_rules.apply_cascade(empty, quality_rules.plan_cascade(empty)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_repeated_windows(ids):
    assert quality_rules.repeated_window_words(np.array(ids, np.int64)) == h.repeated_words(ids)


def test_rules_reject_junk():
    rejects = lambda t: quality_rules.first_rejection(quality_rules.Doc(t), quality_rules.METHOD_RULES)
    prose = "The reader of this line sees quite ordinary words in it.\nAnd here is one more of them."
    assert rejects(prose) is None
    assert rejects(prose.upper()) == "upper_case" and rejects("a | b | c | d") and rejects("Line one.\n" * 9) == "duplicate_lines"


# 2


def test_substring_dedup(spark):
    rng = random.Random(1)
    passage = ". ".join(" ".join(h.words(rng, 12)).capitalize() for _ in range(5)) + "."
    own = lambda: " ".join(h.words(rng, 30))
    first = f"{own()}. {passage} {own()}"
    rows = [(3, first), (7, f"{own()} {passage}\n{own()}"), (9, passage.replace(" ", "\n", 3)), (1, own()), (8, None), (4, ""), (None, passage), (2, "Short line."), (5, "Short line.")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], h.DOCS)
    runs = substring_dedup.removed_runs(clash(df)).collect()
    assert {r.doc_id for r in runs} == {7, 9} and all(r.first_doc_id == 3 for r in runs)
    text = dict(rows)
    for r in runs:
        assert text[r.doc_id][r.start : r.end].split()[-1] == passage.split()[-1] and r.n_words >= 48
    left = substring_dedup.cut(clash(df), substring_dedup.removed_runs(df))
    assert left.columns == clash(df).columns and {r._runs for r in left.collect()} == {"x"}
    cut = {r.doc_id: r.text for r in left.collect()}
    assert cut[3] == first and passage[-40:] not in cut[7] and cut[8] is None and cut[2] == "Short line." and len(cut) == len(rows)
    assert substring_dedup.removed_runs(df.limit(0)).count() == 0


def test_passages_cut_at_arbitrary_words(spark):
    """51 repeated words are found whole wherever they are cut, and inside one document."""
    rng = random.Random(5)
    word = lambda: rng.choice(["it", "The", "end.", "-", "x,", "Sea", "a"]) + str(rng.randrange(10**6)) * rng.randrange(2)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, want = [" ".join(own(80))], {}
    for i in range(1, 41):
        passage = [word() + own(1)[0] for _ in range(51 if i % 4 else 29)]
        texts.append(" ".join(own(rng.randrange(1, 40)) + passage + own(rng.randrange(1, 40))))
        if i % 4:
            want[len(texts)] = " ".join(passage)
        texts.append(" ".join(own(rng.randrange(1, 40)) + passage + own(rng.randrange(1, 40))))
    twice = own(40)
    texts += [" ".join(twice + own(3) + twice), "tick " * 100]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], h.DOCS)
    runs = substring_dedup.removed_runs(df).collect()
    found = {r.doc_id: texts[r.doc_id][r.start : r.end] for r in runs}
    assert len(runs) == len(found) and found.pop(81) == " ".join(twice) and found.pop(82).split() == ["tick"] * 70
    assert found == want and all(r.first_doc_id == r.doc_id - 1 and r.n_words == 51 for r in runs if r.doc_id < 81)


def test_repeated_windows_by_brute_force(spark):
    """Every window of 30 words that an earlier document has, with anchors in over 1000 documents."""
    rng = random.Random(11)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    shared = [own(70) for _ in range(6)]
    texts = []
    for i in range(1700):
        part = shared[0] if i % 10 else shared[1 + i // 10 % 5]
        at, n = rng.randrange(20), rng.randrange(25, 51)
        part = part[at : at + n]
        if i % 7 == 0:
            part = [*part[: n // 2], "é-x", *part[n // 2 + 1 :]]
        texts.append("\u2003 ".join([" ".join(own(3)), " ".join(part)]) + "\n" + "  ".join(own(2)))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], h.DOCS)
    first: dict = {}
    want = set()
    for i, t in enumerate(texts):
        words = [m.span() for m in common.WORD.finditer(t)]
        keys = [tuple(t[a:b] for a, b in words[k : k + 30]) for k in range(len(words) - 29)]
        runs: list = []
        for k, key in enumerate(keys):
            if first.get(key, i) < i:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + 30
                else:
                    runs.append([k, k + 30, first[key]])
        for key in keys:
            first.setdefault(key, i)
        want |= {(i, words[b][0], words[e - 1][1], e - b, f) for b, e, f in runs}
    assert len(want) > 900 and max(texts.count(t) for t in texts) == 1
    assert {tuple(r) for r in substring_dedup.removed_runs(df).collect()} == want


# 3


def test_decontamination(spark):
    q = "Maria has 12 apples and buys 30 more apples for 5 dollars at the old market near the river"
    same = "so, Maria has 12 apples and buys 30 more apples for 5 dollars at the old market near the river, he wrote"
    other = "the pupil said that Tom has 7 apples and buys 99 more apples for 3 euros at the old market near the river"
    twisted = "we know Maria has 12 apples and buys 12 more apples for 5 dollars at the old market near the river"
    rng = random.Random(2)
    noise = [" ".join(h.words(rng, 40)) for _ in range(20)]
    texts = [same, other, twisted, None, "", *noise, same]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, same, "en", "s", 0)], h.DOCS)
    bench = spark.createDataFrame([(1, "I know that " + q + "."), (2, "too short"), (3, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contaminated(clash(docs), bench).collect()}
    # The twisted one is found too: one value in 19 words is all that is inconsistent.
    assert set(got) == {0, 1, 2, len(texts) - 1, None} and all(r.item_id == 1 for r in got.values())
    assert got[0].verbatim and not got[1].verbatim and got[1].n_slots >= 3
    kept = decontaminate.drop_contaminated(docs, bench)
    assert {r.doc_id for r in kept.collect()} >= {3, 4, 5} and kept.where("doc_id in (0, 1, 2)").count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


LEAKS = [
    ("Maria has 12 apples and buys 30 more apples for 5 dollars at the old market near the river", "CAPITALS: MARIA HAS 12 APPLES AND BUYS 30 MORE APPLES FOR 5 DOLLARS AT THE OLD MARKET NEAR THE RIVER!"),
    ("Name the deepest lake of Asia", "he asked us to name the deepest lake of Asia again"),
    ("Anna Bella Carla Dora Emma Fiona Greta Hanna Irma Julia Karla Lena", "They are Anna Bella Carla Dora Emma Fiona Greta Hanna Irma Julia Karla Lena as said"),
    ("12 14 16 18 20 22 24 26 28 30 32 34 36", "numbers 12 14 16 18 20 22 24 26 28 30 32 34 36 end"),
    ("when Tom saw the big red boat he told Tom to wait for it by the blue gate until noon", "and when Tom saw the big red boat he told Ann to wait for it by the blue gate until noon"),
    ("the car goes 60 miles in one hour and then 45 miles in the next so how far does it go", "so the car goes 80 miles in one hour and then 80 miles in the next so how far does it go"),
]


def test_leaks_of_every_kind(spark):
    """Capitals, short items, items of names or numbers, one edited value, and values that become equal."""
    rng = random.Random(9)
    clean = [" ".join(h.words(rng, 60)) for _ in range(20)] + ["Bob Carl Dan Ed Frank Gus Hal Ian Jack Karl Leo Max", "1 2 3 4 5 6 7 8 9 10 11 12 13 14", "name the lake", "YES", "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([d for _, d in LEAKS] + clean)], h.DOCS)
    bench = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(LEAKS)] + [(98, "yes"), (99, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(i, i) for i in range(len(LEAKS))}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, most=1).collect()} == got


def test_decontamination_equals_plain_python(spark):
    """Random texts with whole, edited, cut and re-parameterised items against every shift of every item."""
    rng = random.Random(14)
    vocabulary = ["Tom", "Ann", "the", "a", "red", "runs", "sees,", "3", "4", "15", "km", "of", "boat.", "X", "to", "by", "--", "gate", "old", "Rivers"]
    text = lambda n: [rng.choice(vocabulary) + (str(rng.randrange(30)) if rng.random() < 0.4 else "") for _ in range(n)]
    items = [text(rng.choice((3, 6, 9, 14, 30))) for _ in range(12)]
    docs = []
    for i in range(60):
        w = list(rng.choice(items))
        for _ in range(rng.choice((0, 0, 1, 3))):
            w[rng.randrange(len(w))] = text(1)[0]
        at = rng.choice((0, 0, 0, len(w) // 3))
        docs.append(" ".join(text(rng.randrange(12)) + w[at:] + text(rng.randrange(12))).upper() if i % 7 == 0 else " ".join(text(rng.randrange(12)) + w[at:] + text(rng.randrange(12))))
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(docs)], h.DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words) for r in decontaminate.contaminated(frame, bench).collect()}
    want = {(d, i): found for d, t in enumerate(docs) for i, w in enumerate(items) if (found := h.leak(t, " ".join(w)))}
    assert got == want and len(want) > 20


# 4 and 7


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=300), st.integers(0, 200))
def test_word_coding(values, run):
    v = np.array(values + [5] * run, np.uint64)
    packed, escapes = tokens.pack_ids(v)
    assert (tokens.unpack_ids(packed, escapes, len(v)) == v).all()


def test_runs_and_widths_are_dense():
    assert len(tokens.pack_ids(np.zeros(10_000, np.uint64))[0]) == 1
    assert len(tokens.pack_ids(np.arange(1000) % 2)[0]) == 17


def test_encoder_equals_library():
    e = tokens.Encoder(tokenizer_path(), entries=50)
    texts = ["It's we'll 'sx ''s don't", "İstanbul ΟΔΥΣΣΕΥΣ áb é", "x<|endoftext|>y", " a\u0085b²3½ ªº µ", "日本語 😀 ﬁ", "a\x1cb\x00c", "ß Straße ÀÉ", "x" * 200, "", None]
    for t in texts * 2:
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.library.encode(t or "", add_special_tokens=False).ids


def test_plain_texts_need_the_model_alone():
    """Pieces of plain texts go to the library's model, kept or not, and never through its whole chain again."""
    plain = "".join(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]))
    texts = ["It's we'll ''s don't 12 ...", "Straße ÀÉ ciónasiemi ñ² ¼x", plain, " ".join(plain), "a" * 200, "ß" * 100]
    for entries in (0, 3, 1000):
        e = tokens.Encoder(tokenizer_path(), entries=entries)
        e._ask = None
        for t in texts * 2:
            assert np.frombuffer(e.encode(t), "<u4").tolist() == e.library.encode(t, add_special_tokens=False).ids
        assert len(e.cache) <= entries and not any(len(p) > e.longest for p in e.cache)


def ids_of(text):
    return np.array(tokens.Encoder.at(tokenizer_path()).library.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_token_files(spark, rows, docs, empty):
    path = common.work_folder(spark)
    tokens.write_tokens(clash(docs), path, tokenizer_path(), block_ids=500)
    got = sorted(tokens.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((r[0], ids_of(r[1])) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in got] == [k for k, _ in want]
    at = 0
    for r, (_, ids) in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())) and bytes(r.ids) == ids.tobytes()
        at += len(ids)
    path = common.work_folder(spark)
    tokens.write_tokens(empty, path, tokenizer_path())
    assert tokens.read_tokens(spark, path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 9), max_size=12), st.integers(40, 60))
def test_plan_uses_every_piece(counts, capacity):
    plan = packing.plan_bins(counts, capacity)
    used: dict = {}
    for c in plan:
        assert sum(x * n for x, n in c.uses) <= capacity and c.bins > 0
        for x, n in c.uses:
            used[x] = used.get(x, 0) + n * c.bins
    assert used == counts


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), max_size=6), st.integers(1, 40))
def test_fullest_is_fullest(counts, room):
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    used = packing.fullest(counts, room)
    assert sum(x * n for x, n in used.items()) == max(s for s in sums if s <= room) and all(n <= counts[x] for x, n in used.items())


def test_packing(spark, rows, docs, empty):
    got = packing.pack(clash(docs), tokenizer_path(), capacity=64).collect()
    want = h.groups((r[0], ids_of(r[1])) for r in rows)
    bins = h.groups((r.sequence_id, (r.offset, r.length)) for r in got)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    for r in got:
        assert r.ids_crc32 in {zlib.crc32(x[r.start : r.start + r.length].tobytes()) for x in want[r.doc_id]}
    total = sum(len(x) for v in want.values() for x in v)
    assert sum(r.length for r in got) == total and len(bins) <= total / 64 * 1.05 + 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


# 5


def test_classifier(spark, empty):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        good = i % 3 > 0
        w = h.words(rng, 60) if good else [rng.choice("xyz") + "!!"] * 30
        rows.append((i, " ".join(w), "en", "s", 0))
    rows += [(400, None, "en", "s", 0), (401, "", "en", "s", 0), (None, "some words", "en", "s", 0)]
    docs = spark.createDataFrame(rows, h.DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    stats = classifier.with_statistics(clash(docs))
    model = classifier.fit(stats, labels, features=64)
    got = {r.doc_id: r.score for r in classifier.score(stats, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == len(rows) and all(0 <= x <= 1 for x in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.97
    assert {r.doc_id for r in docs.where(classifier.held_out(F.col("doc_id"))).collect()} == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0}
    kept = classifier.keep_good(clash(docs), labels, 0.5, features=64)
    assert {r.doc_id for r in kept.collect()} == {i for i, x in got.items() if x >= 0.5} and kept.columns == clash(docs).columns
    blank = classifier.fit(classifier.with_statistics(empty), labels.limit(0))
    assert {r.score for r in classifier.score(stats, blank).collect()} == {0.5}


def test_classifier_equals_one_process(spark):
    """Partial sums, folds and bins against the same model fitted on one matrix."""
    rng, n = np.random.default_rng(3), 500
    x = rng.normal(size=(n, len(classifier.STATISTICS))).astype(np.float32)
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(float)
    rows = [(i, x[i].tolist()) for i in range(n)]
    stats = spark.createDataFrame(rows, "doc_id long, x array<float>").repartition(40)
    labels = spark.createDataFrame([(i, int(y[i])) for i in range(n)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in classifier.score(stats, classifier.fit(stats, labels, features=32)).collect()}
    want = h.one_process(x.astype(float), y, [zlib.crc32(str(i).encode()) % 5 for i in range(n)], 32)
    assert np.allclose([got[i] for i in range(n)], want, atol=1e-6)


def test_sums_of_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(classifier, "FAN", 2)
    test_classifier_equals_one_process(spark)


def test_isotonic():
    x, y = classifier.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and len(x) == len(y)


# 6


CASES = [
    "mail a.b+c@x-y.example.com, or a@b.c@d.e_f@g.h.", "10.0.0.1 and 999.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111 or 4111111111111112", "4111111111111111 4111111111111111",
    "call +1 (017) 555-7713 or +44 20 7946 0958, +1 2", 'token = "c80fd45a66f8564ae70609f7b2a26100e64e830e" here', "é 4111-1111-1111-1111 ü +12 345 678 901", "1 2 3 4 5 6 7 8 9 0 1 2 3", None, "", "plain text", "@ + . 1",
    "9" * 3000, "a@" * 500, "1.2.3.4" * 40, "0" * 13, "+" + "1-" * 8 + "1",
]


def test_base_spans(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(clash(df)).collect()}
    for i, text in enumerate(CASES):
        want = h.base_spans(text)
        assert [(x.kind, x.s, x.e) for x in got[i].base] == want, text
        assert {*want} <= {(x.kind, x.s, x.e) for x in got[i].spans}
    assert pii.find(df.limit(0)).count() == 0


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+- ()5", max_size=60), min_size=1, max_size=30))
def test_base_spans_of_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = df.select("doc_id", *(pii.base_spans(F.col("text"), k).alias(k) for k in pii.KINDS)).collect()
    for r in rows:
        assert [(k, x.s, x.e) for k in pii.KINDS for x in r[k]] == h.base_spans(texts[r.doc_id])


def test_redaction(spark):
    df = spark.createDataFrame([(0, "é mail a@b.co now, +1 (017) 555-7713."), (1, None), (2, "clean"), (3, 'token = "c80fd45a66f8564ae70609f7b2a26100e64e830e"')], "doc_id long, text string")
    wide = clash(df)
    assert pii.redact(wide).columns == wide.columns and {(r.base, r.more, r._found) for r in pii.redact(wide).collect()} == {("x", "x", "x")}
    assert pii.redact(df.limit(0)).count() == 0
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got[0] == "é mail <email> now, <phone>." and got[1] is None and got[2] == "clean" and got[3] == 'token = "<secret>"'


def test_secret_candidates(spark):
    """A key is a candidate whatever else the text holds, and whatever its length."""
    keys = ["sk_live_aB3dE5fG7hJ9kL2mN4", "sk_live_aB3dE5fG7hJ9kL2mN4", "eyJ" + "aB3d" * 300, "x" * 250 + "1", "1" * 250 + "x"]
    texts = [f"the key {k} is here" + " in 2024" * (i == 1) for i, k in enumerate(keys)] + ["z" * 300, "no key", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.more if x.kind == "secret"] for r in df.select("doc_id", pii.candidates(F.col("text")).alias("f")).select("doc_id", "f.more").collect()}
    assert got == {i: [("secret", 8, 8 + len(keys[i]))] if i < len(keys) else [] for i in range(len(texts))}


def test_reliabilities():
    model = pii.train({"card:y-yy-2": 50, "card:--yy-2": 30, "card:--nn-2": 40, "secret:-y-yy5": 20, "secret:---nn2": 60})
    assert "card:--yy-2" in model.accepted and "card:--nn-2" not in model.accepted and "secret:---nn2" not in model.accepted
    assert pii.train({}).accepted == ()


# 8


def test_near_duplicates(spark, rows, docs, empty):
    got = near_dup.near_duplicates(clash(docs)).collect()
    want = h.components(rows)
    assert len(got) == len(rows)
    sizes = {r[0]: len(h.shingles(r[1])) for r in rows}
    for r in got:
        assert r.n_shingles == sizes[r.doc_id]
        assert (r.component_id, r.kept) == ((want[r.doc_id], want[r.doc_id] == r.doc_id) if r.doc_id is not None else (None, True))
    assert near_dup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize(("percent", "exact"), [(50, False), (70, False), (95, False), (85, True), (40, True)])
def test_near_duplicates_at_other_thresholds(spark, percent, exact):
    """Chains of edits link by any threshold, with sketches or whole sets."""
    rng, rows = random.Random(percent), []
    for _ in range(12):
        w = h.words(rng, rng.choice((8, 60, 400)))
        for _ in range(5):
            rows.append((len(rows), " ".join(w), "en", "s", 0))
            for _ in range(rng.randint(0, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(999)}"
    got = near_dup.near_duplicates(h.frame(spark, rows), percent=percent, exact=exact).collect()
    assert {r.doc_id: r.component_id for r in got} == h.components(rows, percent)


def edited(seed=8, n=60):
    """Documents of three groups that share a passage, edited alike or not."""
    rng, out = random.Random(seed), {}
    common = h.words(rng, 30)
    bases = [h.words(rng, 100) + common for _ in range(3)]
    for i in range(n):
        w = list(bases[i % 3])
        for _ in range(i % 7):
            w[rng.randrange(100)] = f"e{rng.randrange(9)}"
        out[i] = np.array(sorted({hash(x) & (2**62 - 1) for x in h.shingles(" ".join(w))}), np.int64)
    return out


def forest(links, nodes):
    """Node -> smallest node that the links reach."""
    label = {x: x for x in nodes}
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = {x: low if y == high else y for x, y in label.items()}
    return label


@pytest.mark.parametrize("docs", [5, 13, 500])
def test_cells_join_what_pairs_join(spark, docs):
    """A cluster cut into cells of any size joins the components that all pairs join, by few links."""
    sets = edited()
    # Groups of one base start as one component, but for every fourth document.
    component = {i: i if i % 4 == 0 else min(x for x in sets if x % 3 == i % 3 and x % 4) for i in sets}
    members = spark.createDataFrame([(1, i, len(s), component[i]) for i, s in sets.items()], "cluster long, doc long, n long, component long")
    table = spark.createDataFrame([(i, len(s), s.tolist()) for i, s in sets.items()], "doc long, n long, s array<long>")
    got = [(r.a, r.b) for r in near_dup.spanning(members, table, 85, docs=docs).collect()]
    want = [(component[a], component[b]) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))]
    nodes = set(component.values())
    assert forest(got, nodes) == forest(want, nodes)
    blocks = -(-len(sets) // docs)
    assert len(got) <= blocks * blocks * (len(nodes) - 1)


def test_documents_of_several_texts_are_one_node(spark):
    rng = random.Random(12)
    x, y = h.words(rng, 60), h.words(rng, 60)
    near = lambda w, e: " ".join([*w[:-1], e])
    rows = [(1, near(x, "a")), (7, near(x, "b")), (7, near(y, "c")), (9, near(y, "d")), (9, near(y, "d")), (4, "another text of its own entirely")]
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(h.frame(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()}
    assert got == {(1, 1), (7, 1), (9, 1), (4, 4)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 3), (5, 6), (7, 7), (30, 20), (20, 10), (10, 25)], "a long, b long")
    assert {r.node: r.component for r in common.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5, 30: 10, 20: 10, 10: 10, 25: 10}


def test_hot_keys_join(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("s"))
    unique = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"))
    got = common.join_unique(big, unique, "k", "s", least=100)
    assert got.count() == 5000 and got.where("k = 0").count() == 4000 and got.where("x <> k * 2").count() == 0


# 9


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1", "https://x.net", "https://x.net/", "http://example.com/de/x?y", "http://notexample.com/de/", "http://a.org/fr/z#t", "http://m.casino-win.example.com/en/", "http://example.com/ads/1", "http://example.com/roads/1", "no scheme", None, "", "http://ads.example.com", "http://h?x=/de/", "http://casino.org/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(clash(df)).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.net/en/", "allow"), (None, "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "block"), (None, "block"),
        (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), ("org/fr/", "allow"),
    ]
    assert (got[0].host, got[0].path, got[13].host, got[13].path, got[9].host) == ("a.example.net", "/en/1", "h", "", "")
    assert url_filter.judge_urls(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ads-casino./?=&_tr", max_size=25))
def test_rule_index_loses_nothing(tail):
    """Judging by the index equals running every expression."""
    import re

    url = "http://" + tail
    index, always = url_filter.index_rules(url_filter.PATTERN_RULES, {})
    near = {r.text for t in re.findall("[a-z0-9]+", url) for r in index.get(t, ())} | {r.text for r in always}
    assert {r.text for r in url_filter.PATTERN_RULES if r.hits(url)} <= near


# 10


def test_extraction(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Menu one</a></li></ul></nav><div class=ad>Buy this now.</div><article><h1>A &amp; B</h1><p><b>First  line\nof text.<br><p>Second line here, too.</p><script>var t='</p>';</script></article><footer>&copy; me</footer></body>"
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>" * 3), (5, "u", "<a <b 'x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == "A & B\nFirst line of text.\nSecond line here, too." and [got[i].text for i in (2, 3, 4)] == ["", "", ""] and got[1].url == "u" and 5 in got


def test_extraction_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "<p>One line of it.</p>")], "page_id long, html string").withColumns({c: F.lit("x") for c in ("n", "label", "path", "score", "_found")})
    got = html_extract.extract(df)
    assert got.columns == ["page_id", "n", "label", "path", "score", "_found", "text"] and html_extract.extract(df.limit(0)).count() == 0


def test_whole_blocks_count():
    """Words and digits count wherever they stand in a block."""
    block = lambda t: html_extract.Block(t, (("p",),))
    same = "word " * 300
    one, two = (html_extract.vectors([block(same + x)]) for x in ("zebra 1", "giraffe a"))
    assert (one != two).sum() >= 3


def test_held_out_labels():
    model = html_extract.trained()
    test = html_extract.training_pages(150, 77)
    scores = model.scores([x for x, _ in test])
    right = np.concatenate([(s >= 0.5) == (y > 0.5) for s, (_, y) in zip(scores, test, strict=True)])
    assert right.mean() > 0.97


def test_gradients():
    """Analytic against numeric."""
    page = html_extract.training_pages(2, 5)
    model = html_extract.Labeller(hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    xs, ys = [x for x, _ in page], [y for _, y in page]

    def loss():
        total = n = 0
        for s, y in zip(model.scores(xs), ys, strict=True):
            s = np.clip(s.astype(np.float64), 1e-9, 1 - 1e-9)
            total, n = total - (y * np.log(s) + (1 - y) * np.log(1 - s)).sum(), n + len(y)
        return total / n

    grads = model.gradients(xs, ys)
    for key, at in (("hf", (1, 4)), ("hb", (0, 7)), ("cf", (5,)), ("cb", (2,)), ("out", (3, 0))):
        old = model.p[key][at]
        model.p[key][at] = old + 1e-3
        up = loss()
        model.p[key][at] = old - 1e-3
        down = loss()
        model.p[key][at] = old
        assert grads[key][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(6)
    passage = " ".join(h.words(rng, 30))
    good = [" ".join(h.words(rng, rng.randint(40, 90))) for _ in range(120)]
    bad = [" ".join([rng.choice("xyz") + "!!"] * 40) for _ in range(60)]
    texts = good + bad + [good[0], " ".join(good[1].split()[:-1] + ["end"]), good[2] + " " + passage, " ".join(h.words(rng, 60)) + " me@mail.example.com"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    h.frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialise(stage(spark, docs, str(tmp_path)), name)
        kept.append(docs)
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in kept]
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in kept[:4])
    assert ids[0] == set(range(120)) | set(range(180, 184))
    near = h.components([r for r in rows if r[0] in ids[0]], 80)
    assert ids[1] == {d for d, c in near.items() if d == c} and 180 not in ids[1] and 181 not in ids[1]
    assert ids[2] == ids[1] - {182} and ids[3] == ids[2] == ids[4]
    redacted = kept[3].where("doc_id = 183").first()
    assert redacted.text.endswith("<email>") and redacted.n_chars == len(redacted.text)
    total = sum(len(ids_of(r.text)) for r in kept[3].collect())
    assert kept[4].agg(F.sum("length")).first()[0] == total
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


@pytest.mark.parametrize("some", [True, False])
def test_stages_on_odd_rows(spark, tmp_path, some):
    """Nulls, empty texts, rows that share an id, columns named like results, and empty tables."""
    import corpus_pipeline

    rng = random.Random(7)
    text = " ".join(h.words(rng, 60))
    rows = [(1, text, "en", "s", 9), (1, text, "en", "s", 9), (2, text, None, None, None), (None, text, "en", "s", 9), (None, None, "en", "s", 9), (3, None, "en", "s", 9), (4, "", "en", "s", 0)] * some
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = clash(h.frame(spark, rows))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    kept = sorted((r.doc_id or 0, r.text) for r in docs.where("text is not null").collect())
    assert kept == ([(0, text), (1, text), (1, text), (4, "")] if some else [])
    assert docs.where("text is null").count() == 2 * some
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.agg(F.sum("length")).first()[0] == (sum(len(ids_of(t)) for t in (text, text, text, "", None, None)) if some else None)
