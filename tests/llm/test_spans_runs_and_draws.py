"""Personal data, periodic runs and importance resampling, each against a plain version."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from sensorlab.llm import importance, periodic, personal
from sensorlab.llm.queries import QUERIES
from tests.llm.test_documents import by_id, clashing, none, odd, odd_rows  # noqa: F401


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


# --- personal data -----------------------------------------------------------

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_personal(text):
    tests = {
        "email": lambda m: True,
        "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
        "card": lambda m: 16 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and plain_luhn(d),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [
        (*m.span(), kind)
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if tests[kind](m[0])
    ]


def check_personal(rows, texts):
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts):
        spans = plain_personal(text)
        kinds = Counter(k for _, _, k in spans)
        assert [row[f"n_{k}"] for k in personal.BASE] == [kinds[k] for k in personal.BASE]
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert row["spans"] == joined or row["spans"].startswith(joined + "," if joined else "")


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(5)
    alphabet = list("a.1@+- 0 2(5)%@.4+é")
    for _ in range(4000):
        text = "".join(rng.choice(alphabet, int(rng.integers(0, 60))))
        assert personal.base_spans(text) == plain_personal(text), text
    for text in ("a@b.c@d.e", "a@b@c.d", "+1 23456-7890-", "1.2.3.4.5.6.7.8", "0255.1.1.256 0000255.1.1.1"):
        assert personal.base_spans(text) == plain_personal(text)
    assert personal.base_spans("4111 1111-1111 1111") == [(0, 19, "card")]
    assert personal.base_spans("9" * 6000 + ".1.1.1") == []


def test_personal_query(spark, sf_dir, documents):
    rows = by_id(QUERIES["op11_personal_data"](spark, sf_dir))
    check_personal([rows[i] for i, _ in documents], [t for _, t in documents])


def test_personal_data_of_odd_rows(odd, clashing, none):  # noqa: F811
    rows = personal.scan_personal(odd).collect()
    check_personal(rows, [r["text"] for r in rows])
    rows = personal.scan_personal(clashing).collect()
    assert len(rows) == len(odd_rows()) and rows[0]["kept"] == "x"
    check_personal(rows, [r["text"] for r in rows])
    assert personal.scan_personal(none).count() == 0
    assert personal.redact_personal(odd).count() == len(odd_rows())


SENTENCES = [
    ("My name is Anna Keller and I moved.", [("Anna Keller", "person")]),
    ("Dear Mr. Thomas Wright, thank you.", [("Thomas Wright", "person")]),
    ("SSN: 123-45-6789 was given.", [("123-45-6789", "national_id")]),
    ("Your IBAN is DE89 3704 0044 0532 0130 00.", [("DE89 3704 0044 0532 0130 00", "iban")]),
    ("Call me at (555) 123-4567 tomorrow", [("(555) 123-4567", "local_phone")]),
    ("Ship to 221 Baker Street, London", [("221 Baker Street", "address")]),
    ("Geboren am 12.03.1985 in Hamburg", [("12.03.1985", "birth_date")]),
    ("The river rose in 1985 and fell again.", []),
    ("HOME | ABOUT | CONTACT\nHOME | ABOUT", []),
    ("The The The The The The The The The The", []),
    ("In March the council of Berlin met 12 times.", []),
]


def reader():
    field = personal.trained_field()
    return field, personal.Tokens(field.cues)


def test_field_on_written_sentences_and_held_out_rows():
    found = personal.added_spans([t for t, _ in SENTENCES], *reader())
    for (text, wanted), spans in zip(SENTENCES, found):
        assert [(text[a:b], k) for a, b, k in spans] == wanted, text
    rows = personal.labelled_rows(1500, seed=1234)
    found = personal.added_spans([t for t, _ in rows], *reader())
    right = sum(len(set(s) & set(f)) for (_, s), f in zip(rows, found))
    assert 2 * right / sum(len(s) + len(f) for (_, s), f in zip(rows, found)) >= 0.88


def test_decoding_is_the_best_path():
    """Settled tokens and stretches give the labels that Viterbi over whole texts gives."""
    field, tokens = reader()
    for text, _ in personal.labelled_rows(150, seed=9) + [(" ".join(t for t, _ in SENTENCES), [])]:
        shapes, cues, gaps, _, _ = tokens.read(text)
        edge = np.zeros(personal.REACH, np.int64)
        wide = [np.concatenate((edge, x, edge)) for x in (shapes, cues, gaps)]
        every = np.arange(len(shapes)) + personal.REACH
        scores = field.scores_at(every, *wide)
        best = field.steps[0] + scores[0]
        back = []
        for own in scores[1:]:
            paths = best[:, None] + field.steps
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + own
        path = [int((best + field.steps[:, 0]).argmax())]
        for choice in reversed(back):
            path.append(int(choice[path[-1]]))
        assert field.labels(*wide)[every].tolist() == path[::-1]


def test_added_spans_keep_off_base_spans_and_redaction_covers_all():
    text = "Contact: Anna Keller, +1 (555) 555-1234 or anna.keller@example.com today."
    (spans,) = personal.find_spans([text], *reader())
    assert [k for _, _, k in spans][:2] == ["email", "phone"]
    assert (9, 20, "person") in spans
    for a, b, kind in spans:
        if kind in personal.ADDED:
            assert all(b <= c or d <= a for c, d, k in spans if k in personal.BASE)


@pytest.mark.parametrize(
    "piece", ["a", "a@", "1", "1.", "+1 ", "1 ", "ABC ", "Mr. Adam ", "123-45-6789 ", "é", "\n"]
)
def test_personal_data_of_long_texts_takes_linear_time(piece):
    text = piece * (300_000 // len(piece))
    begun = time.monotonic()
    personal.find_spans([text], *reader())
    assert time.monotonic() - begun < 20


def test_other_labelled_tables_can_be_fitted():
    rows = [(f"badge {n} of {w}", [(6, 6 + len(str(n)), "national_id")]) for n, w in
            zip(range(1000, 1100), "oak elm ash fir yew".split() * 20)]
    rows += [(f"{n} leaves of {w}", []) for n, w in zip(range(1000, 1100), "oak elm ash fir yew".split() * 20)]
    field = personal.fit_field(rows, ["badge", "leaves", "of"])
    found = personal.added_spans(["badge 4711 of pine", "4711 leaves of pine"], field, personal.Tokens(field.cues))
    assert found == [[(6, 10, "national_id")], []]
    with pytest.raises(ValueError, match="token"):
        personal.fit_field([("abcd", [(1, 3, "iban")])], [])


# --- periodic runs -------------------------------------------------------------


def plain_runs(words):
    out = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def check_runs(row, doc_id, text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and words:
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
    runs = plain_runs(words)
    assert row["n_runs"] == len(runs)
    if runs:
        a, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        assert (row["start"], row["length"], row["period"], row["exponent_milli"]) == (a, n, q, 1000 * n // q)
    else:
        assert row["start"] is row["length"] is row["period"] is row["exponent_milli"] is None
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    assert row["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()


def test_periodic_query(spark, sf_dir, documents):
    rows = by_id(QUERIES["op12_periodic_runs"](spark, sf_dir))
    assert len(rows) == len(documents)
    for doc_id, text in documents:
        check_runs(rows[doc_id], doc_id, text)


def test_runs_of_odd_rows(odd, clashing, none, spark):  # noqa: F811
    short = [r for r in odd_rows() if len((r[1] or "").split()) < 5000]
    rows = periodic.run_report(spark.createDataFrame(short, odd.schema)).collect()
    assert len(rows) == len(short)
    wanted = {(r[0], r[1]) for r in short}
    for row in rows:
        for doc_id, text in (w for w in wanted if w[0] == row["doc_id"] and w[0] is not None):
            check_runs(row, doc_id, text)
    assert periodic.run_report(none).count() == 0
    found = periodic.collapse_runs(clashing)
    assert found.count() == len(odd_rows()) and set(found.columns) >= {"runs", "collapsed", "kept"}


def test_runs_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(400):
        texts = []
        for _ in range(int(rng.integers(1, 6))):
            n = int(rng.choice([0, 1, 5, 6, 7, 25, 80, 260]))
            own = [b"%d" % x for x in rng.integers(0, rng.choice([1, 2, 3, 40]), n)]
            if n > 10 and rng.random() < 0.6:
                a = int(rng.integers(n))
                p = 1 + (n - a) // int(rng.integers(3, 10))
                own = own[:a] + [own[a + (i - a) % p] for i in range(a, n)]
            texts.append(own)
        assert periodic.runs_of_texts(texts) == [plain_runs(t) for t in texts]


def test_transforms_are_exact():
    rng = np.random.default_rng(4)
    for n in (2, 64, 128, 8192):
        x, y = (rng.integers(0, periodic.PRIME, (2, n)) for _ in range(2))
        product = periodic.transform(x.astype(float)) * periodic.transform(y.astype(float))
        found = periodic.inverse(periodic._reduce(product)).astype(np.int64) % periodic.PRIME
        spun = [sum(int(x[0, j]) * int(y[0, (i - j) % n]) for j in range(n)) for i in range(0, n, n // 2)]
        assert [int(v) for v in found[0, :: n // 2]] == [n * v % periodic.PRIME for v in spun]


def test_long_and_repetitive_texts():
    for words in ([b"a"] * 300_000, ([b"a"] * 299 + [b"b"]) * 1000):
        begun = time.monotonic()
        (runs,) = periodic.runs_of_texts([words])
        assert time.monotonic() - begun < 30
        assert (0, len(words), 1 if words[-1] == b"a" else 300) in runs
    a = [b"%d" % i for i in range(9000)]
    assert periodic.runs_of_texts([[b"x", *a, *a, *a, *a, b"y"]]) == [[(1, 36_000, 9000)]]


# --- importance resampling -------------------------------------------------------


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_features(text, longest):
    found = plain_words(text)
    return [" ".join(found[i : i + n]) for n in range(1, longest + 1) for i in range(len(found) - n + 1)]


def plain_resample(docs, target, buckets, longest, least, per_cent, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in docs for f in plain_features(text, longest))
    t = Counter(bucket(f) for text in target for f in plain_features(text, longest))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
        for b in range(buckets)
    ]
    out = []
    for doc_id, text in docs:
        gains = [gain[bucket(f)] for f in plain_features(text, longest)]
        weight = math.floor(sum(gains) / len(gains)) if gains else 0
        name = f"{seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(gains), weight, score, None, len(plain_words(text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, row in enumerate(able[: per_cent * len(able) // 100]):
        row[4] = i + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    names = ("doc_id", "n_features", "weight", "score", "rank")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_resampling_query(spark, sf_dir, documents):
    target = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = rows_of(QUERIES["op13_importance_resampling"](spark, sf_dir))
    assert found == plain_resample(documents, target, 10_000, 1, 20, 10)
    assert sum(r[4] is not None for r in found) > 10


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_of_odd_rows(spark, odd, clashing, none, longest):  # noqa: F811
    docs = [(r[0], r[1]) for r in odd_rows()]
    target = ["the quick fox\nand the lazy dog", None, "", "zwei Wörter"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    wanted = plain_resample(docs, target, 50, longest, 20, 40)
    for df in (odd, clashing):
        assert rows_of(importance.resample(df, goal, 50, longest, 2024, 20, 40)) == wanted
    assert importance.resample(none, goal, 50, longest).count() == 0
    empty = plain_resample(docs, [], 50, longest, 20, 40)
    assert rows_of(importance.resample(odd, goal.limit(0), 50, longest, 2024, 20, 40)) == empty


def test_ranks_run_over_ranges_with_ties(spark):
    rows = [(i % 40, 30, 30, 0, (i * 7) % 5) for i in range(2000)]
    scored = spark.createDataFrame(rows, importance.SCORED).repartition(7)
    found = importance.drawn(scored, 20, 90).collect()
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 1801)) and len(found) == 2000
    keys = [(-r["score"], r["doc_id"]) for r in ranked]
    assert keys == sorted(keys)


def test_common_lines_are_counted_once(spark):
    texts = spark.createDataFrame([("a b\nc d\na b",)] * 400 + [("c d",)] * 100, "text string")
    found = {r["bucket"]: r["n"] for r in importance.bucket_counts(texts, 1000, 2).collect()}
    wanted = Counter()
    for text, n in (("a b\nc d\na b", 400), ("c d", 100)):
        for feature in plain_features(text, 2):
            wanted[zlib.crc32(feature.encode()) % 1000] += n
    assert found == dict(wanted)
