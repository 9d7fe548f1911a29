"""Neighbour search and page extraction against brute force and held-out pages."""

import numpy as np
import pyarrow as pa
import pytest

from sensorlab.llm import extraction, neighbours
from sensorlab.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, rank int"


def exact(rows, every=20, k=20):
    """(query, rank, id, score) of all candidates, by all inner products."""
    found = {(i, tuple(v)) for i, v in rows}
    out = []
    for q, x in sorted(found):
        if q % every:
            continue
        scores = sorted(
            (-float(np.dot(np.array(x, np.float64), np.array(y, np.float64))), i)
            for i, y in found
            if i != q
        )
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def rows_of(df):
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect()]


def close(found, wanted):
    found, wanted = sorted(found), sorted(wanted)
    assert [r[:3] for r in found] == [r[:3] for r in wanted]
    assert np.allclose([r[3] for r in found], [r[3] for r in wanted], rtol=0, atol=1e-12)


def test_few_vectors_give_all(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(12)]
    good += [(20 + i, good[3][1]) for i in range(5)] + [(40, good[0][1]), (40, good[0][1])]
    odd = [
        (100, None),
        (120, [0.0] * 4),
        (140, [1.0, None, 0.0, 0.0]),
        (160, [float("nan"), 1.0, 0.0, 0.0]),
        (180, [float("inf"), 1.0, 0.0, 0.0]),
        (200, [1.0, 2.0]),
        (None, [1.0, 1.0, 1.0, 1.0]),
    ]
    df = spark.createDataFrame([(i, v, 1) for i, v in good + odd], SCHEMA).repartition(3)
    close(rows_of(neighbours.nearest(df)), exact(good))
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 100")).count() == 0


def test_many_copies_and_ties(spark, monkeypatch):
    """Copies beyond what a result can hold; ties go to the smaller id; several chunks."""
    monkeypatch.setattr(neighbours, "CHUNK", 16)
    rng = np.random.default_rng(1)
    base = [rng.integers(-3, 4, 6).astype(float).tolist() for _ in range(30)]
    base = [v for v in base if any(v)]
    rows = [(i, base[i % len(base)] if i % 3 else base[0]) for i in range(400)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(4)
    found, wanted = rows_of(neighbours.nearest(df)), exact(rows)
    assert len(found) == len(wanted)
    # chunks of a block are all searched, so what is missed is missed by the probes only
    hits = {r[:1] + r[2:3] for r in found} & {r[:1] + r[2:3] for r in wanted}
    assert len(hits) >= 0.9 * len(wanted)
    scores = {(r[0], r[1]): r[3] for r in found}
    for (q, rank), score in scores.items():
        assert rank == 1 or scores[q, rank - 1] >= score


def test_recall_on_the_tables(spark):
    sf_dir = "/root/testdata/sf0.1"
    found = QUERIES["op6_multiprobe_neighbours"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in table])
    vectors = np.array([r["embedding"] for r in table], np.float64)
    place = {i: n for n, i in enumerate(ids.tolist())}
    hits = 0
    by_query = {}
    for r in found:
        by_query.setdefault(r["query_id"], []).append(r)
    assert set(by_query) == {i for i in ids.tolist() if i % 20 == 0}
    for q, rows in by_query.items():
        scores = vectors @ vectors[place[q]]
        for r in rows:
            assert abs(scores[place[r["vec_id"]]] - r["score"]) < 1e-12
        scores[place[q]] = -np.inf
        order = np.lexsort((ids, -scores))[:20]
        hits += len(set(ids[order].tolist()) & {r["vec_id"] for r in rows})
        assert sorted(r["rank"] for r in rows) == list(range(1, 21))
    assert hits >= 0.9 * 20 * len(by_query)


@pytest.mark.parametrize("tight, sample", [(0.8, 20_000), (0.9, 20_000), (0.9, 400)])
def test_recall_of_loose_and_tight_queries(spark, monkeypatch, tight, sample):
    """Most vectors lie in groups of 40 near copies; the others have no near vectors."""
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", sample)
    rng = np.random.default_rng(3)
    n, dim = 8000, 64
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = np.repeat(unit(rng.normal(size=(int(n * tight) // 40, dim))), 40, axis=0)
    groups = unit(groups + 0.2 / np.sqrt(dim) * rng.normal(size=groups.shape))
    vectors = np.concatenate((groups, unit(rng.normal(size=(n - len(groups), dim)))))
    loose = np.arange(n) >= len(groups)
    order = rng.permutation(n)
    vectors, loose = vectors[order].astype(np.float32).astype(float), loose[order]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors.tolist())], SCHEMA)
    found = {}
    for r in neighbours.nearest(df.repartition(4)).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = {True: [], False: []}
    for q in range(0, n, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        recall[loose[q]].append(len(found[q] & set(np.argsort(-scores)[:20].tolist())) / 20)
    assert np.mean(recall[True]) >= 0.9 and np.mean(recall[False]) >= 0.9


def test_chances_are_those_of_a_near_vector():
    """Near vectors lie in visited buckets as often as estimated."""
    rng = np.random.default_rng(2)
    dim, near = 32, 0.5
    index = neighbours.Index(dim, 200_000, 1.0, near, 20)
    queries = rng.normal(size=(400, dim))
    queries /= np.linalg.norm(queries, axis=1, keepdims=True)
    other = rng.normal(size=(400, dim))
    other -= (other * queries).sum(axis=1, keepdims=True) * queries
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    close_ = near * queries + np.sqrt(1 - near**2) * other
    for table in range(neighbours.TABLES):
        chances = index.chances(table, queries)
        cutoffs = index.cutoffs(chances)
        codes = index.codes(table, close_)
        own = chances[np.arange(400)[:, None], np.arange(index.projections)[None], codes].sum(axis=1)
        reached = own >= cutoffs
        assert abs(reached.mean() - neighbours.SUCCESS) < 0.08
        for i in np.flatnonzero(reached)[:50]:
            block = "".join(map(str, codes[i, : index.prefix].tolist()))
            assert block in index.blocks(chances[i], cutoffs[i])


def test_clustered_vectors_are_met_in_few_buckets():
    """Both tables together hold a query against under a fifth of the vectors."""
    rng = np.random.default_rng(5)
    dim, n, k = 64, 50_000, 20
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    groups = np.repeat(unit(rng.normal(size=(n // 40, dim))), 40, axis=0)
    vectors = unit(groups + 0.35 / np.sqrt(dim) * rng.normal(size=(n, dim)))
    index = neighbours.Index(dim, n, 1.0, 0.0, k)
    picked = rng.choice(n, 60, replace=False)
    queries = vectors[picked]
    scores = queries @ vectors.T
    scores[np.arange(60), picked] = -np.inf
    top = np.argpartition(scores, -k, axis=1)[:, -k:]
    near = np.partition(scores, -k, axis=1)[:, -k].clip(0, neighbours.MOST)
    met, share = np.zeros((60, n), bool), np.zeros(60)
    for table in range(neighbours.TABLES):
        chances = index.chances(table, queries, near)
        marks = index.marks(index.codes(table, vectors))
        reached = chances.reshape(60, -1) @ marks.T >= index.cutoffs(chances)[:, None]
        met |= reached
        share += reached.mean(axis=1)
    assert share.mean() < 0.2
    assert np.take_along_axis(met, top, 1).mean() >= 0.9


def test_queries_without_near_vectors_meet_all(spark):
    """Vectors without groups: buckets save nothing, and the result is exact."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(3000, 48))
    rows = [(i, v, 1) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    found = {}
    for r in neighbours.nearest(df.repartition(4)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    whole = 0
    for q in range(0, 3000, 20):
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        wanted = np.lexsort((np.arange(3000), -scores))[:20].tolist()
        whole += [i for _, i in sorted(found[q])] == wanted
    assert whole >= 0.9 * 150


def _best_pairs(pairs, most):
    return sorted({(-s, i) for i, s in pairs})[:most]


def _rows_found(batches):
    return [r for b in batches for r in b.to_pylist()]


def test_a_task_ranks_all_its_chunks_together():
    """One row for a query, not one for every chunk that it meets; known floors change nothing."""
    rng = np.random.default_rng(8)
    dim, k, chunks = 6, 3, 5
    vectors = rng.integers(-2, 3, (200, dim)).astype(float)
    vectors[vectors.any(axis=1) == 0] = 1.0
    queries = rng.normal(size=(10, dim))
    index = neighbours.Index(dim, len(vectors), float(np.linalg.norm(vectors, axis=1).max()), 0.0, k)
    wanted = {
        q: _best_pairs([(m, float((v * x).sum())) for i, v in enumerate(vectors) for m in (i, 1000 + i)], k + 1)
        for q, x in enumerate(queries)
    }
    schema = pa.schema(
        [("chunk", pa.string()), ("is_query", pa.bool_()), ("vec_id", pa.int64())]
        + [(c, pa.float64()) for c in ("cutoff", "near", "floor", "bound")]
        + [("members", pa.list_(pa.int64())), ("codes", pa.list_(pa.int32())), ("vector", pa.list_(pa.float64()))]
    )
    none = dict(cutoff=0.0, near=0.0, floor=None, bound=None, members=None, codes=None)
    for floors in (False, True):
        rows = []
        for c in range(chunks):
            rows += [
                {**none, "chunk": f"all:{c}", "is_query": False, "vec_id": i, "members": [i, 1000 + i], "vector": v.tolist()}
                for i, v in enumerate(vectors)
                if i % chunks == c
            ]
            rows += [
                {**none, "chunk": f"all:{c}", "is_query": True, "vec_id": q, "vector": x.tolist()}
                | ({"floor": -wanted[q][-1][0]} if floors and q % 2 else {})
                for q, x in enumerate(queries)
            ]
        table = pa.Table.from_pylist(rows, schema)
        found = _rows_found(neighbours._search(index)(iter(table.to_batches(max_chunksize=33))))
        assert len(found) == len(queries)
        for r in found:
            assert list(zip([-s for s in r["scores"]], r["ids"])) == wanted[r["vec_id"]]


def test_what_tasks_found_is_merged_by_query():
    """Rows of a query may be many and lie in several batches; pairs found twice are one."""
    rng = np.random.default_rng(9)
    rows, all_pairs = [], {}
    for q in (-3, 5, 6, 70):
        for _ in range(60):
            pairs = [(int(i), float(rng.integers(-40, 40))) for i in rng.integers(0, 50, 9)]
            all_pairs.setdefault(q, []).extend(pairs)
            rows.append({"vec_id": q, "ids": [i for i, _ in pairs], "scores": [s for _, s in pairs]})
    schema = pa.schema([("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])
    batches = pa.Table.from_pylist(rows, schema).to_batches(max_chunksize=7)
    found = _rows_found(neighbours._merge(21)(iter(batches)))
    assert [r["vec_id"] for r in found] == [-3, 5, 6, 70]
    for r in found:
        assert list(zip([-s for s in r["scores"]], r["ids"])) == _best_pairs(all_pairs[r["vec_id"]], 21)
    assert not list(neighbours._merge(21)(iter([])))


def test_vectors_in_very_many_parts(spark, monkeypatch):
    """All vectors in some 300 parts: the work of merging what was found grows with the parts, not their square."""
    monkeypatch.setattr(neighbours, "ALL_BYTES", 2_500)
    rng = np.random.default_rng(10)
    vectors = rng.normal(size=(2000, 48))
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>, rank int")
    found = {}
    for r in neighbours.nearest(df.repartition(4)).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    scores = vectors[::20] @ vectors.T
    for n, q in enumerate(range(0, 2000, 20)):
        scores[n, q] = -np.inf
        assert [i for _, i in sorted(found[q])] == np.lexsort((np.arange(2000), -scores[n]))[:20].tolist()


# --- pages -----------------------------------------------------------------


def test_field_on_held_out_pages():
    field = extraction.trained_field()
    rng = np.random.default_rng(12345)
    right = blocks = pages = 0
    for _ in range(200):
        page, labels = extraction.labelled_page(rng)
        found = field.labels(extraction.blocks(page))
        right += sum(a == b for a, b in zip(found, labels))
        blocks += len(labels)
        pages += found == [bool(x) for x in labels]
    assert right >= 0.98 * blocks and pages >= 0.9 * 200


def test_viterbi_equals_all_labellings():
    from itertools import product

    rng = np.random.default_rng(4)
    for _ in range(30):
        found = [
            extraction.Block("", [f"f{int(rng.integers(4))}"], int(rng.integers(2)))
            for _ in range(int(rng.integers(1, 7)))
        ]
        weights = {f"f{i}": float(rng.normal()) for i in range(4)} | {"bias": float(rng.normal())}
        field = extraction.Field(weights, rng.normal(size=(2, 2, 2)))

        def score(labels):
            total = 0.0
            for i, (block, label) in enumerate(zip(found, labels)):
                total += label * (weights["bias"] + weights[block.features[0]])
                if i:
                    pairs = field.pairs[found[i - 1].parent == block.parent]
                    total += pairs[labels[i - 1]][label]
            return total

        best = max(product((0, 1), repeat=len(found)), key=score)
        assert np.isclose(score(tuple(map(int, field.labels(found)))), score(best))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    emit = rng.normal(size=(1, 4))
    alive, same = np.ones((1, 4), bool), np.array([[False, True, False, True]])
    pairs = rng.normal(size=(2, 2, 2))
    main, both = extraction._likelihood(emit, None, alive, same, pairs)
    from itertools import product

    weights, marginal, pair = [], np.zeros(4), np.zeros((3, 2, 2))
    for labels in product((0, 1), repeat=4):
        total = sum(e for e, label in zip(emit[0], labels) if label)
        total += sum(pairs[int(same[0, t])][labels[t - 1]][labels[t]] for t in range(1, 4))
        weight = np.exp(total)
        weights.append(weight)
        marginal += weight * np.array(labels)
        for t in range(1, 4):
            pair[t - 1, labels[t - 1], labels[t]] += weight
    assert np.allclose(main[0], marginal / sum(weights))
    assert np.allclose(both[0], pair / sum(weights))


PAGES = [
    (1, None, None),
    (2, "u", ""),
    (3, "u", "<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav></body>"),
    (
        4,
        "u",
        "<body><nav><ul><li><a>A</a><li><a>B</a></ul></nav><article><h1>Big  &amp; &lt;new&gt;</h1>"
        "<p><b>First&nbsp;line<br>goes on, and it is quite a long sentence of plain words.<p>Second &eacute;"
        " paragraph is here as well, with some more plain words.<script>var a='</p>';</script></p><!-- no -->"
        "<div class=ad>Buy now!</div></article><section class='comments'><p>I think so too.</p></section>"
        "<footer>&copy; x</footer>",
    ),
    (5, "u", "<p unclosed='x <b>bold text"),
    (6, "u", "<article>" + "<p>" + "word " * 30_000 + ".</p></article>"),
]


def test_pages(spark):
    schema = "page_id long, url string, html string, text string, extra int"
    df = spark.createDataFrame([(*p, "old", 1) for p in PAGES + PAGES[3:4]], schema)
    rows = extraction.extract_text(df).collect()
    assert len(rows) == 7 and rows[0]["extra"] == 1
    found = {r["page_id"]: r["text"] for r in rows}
    assert found[1] == found[2] == found[3] == ""
    assert found[4] == (
        "Big & <new>\nFirst line goes on, and it is quite a long sentence of plain words.\n"
        "Second é paragraph is here as well, with some more plain words."
    )
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert found[6] == "word " * 30_000 + "."
    assert extraction.extract_text(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("a<br>b <i>c</i>d", ["a b cd"]),
        ("</div></p>x<script>y</script >z", ["xz"]),
        ("<style>x</style><noscript>y</noscript>z<script>w", ["z"]),
        ("a &lt;b&gt; &#65;&amp;amp; &bogus; < c", ["a <b> A&amp; &bogus; < c"]),
    ],
)
def test_leaf_blocks(page, texts):
    assert [b.text for b in extraction.blocks(page)] == texts


@pytest.mark.parametrize(
    "inner, texts",
    [
        ('<p>One.<svg class="i"/> two.</p><p>Three.</p>', ["One. two.", "Three."]),
        ('<p>One.<svg><path d="M0"/><g><path d="M1"></g></svg> two.</p><p>Three.</p>', ["One. two.", "Three."]),
        ("<p>One <svg><title>mark</title><text>A</text><style/></svg> two.", ["One mark A two."]),
        ("<p>Let <math><mi>x</mi><mo>+</mo><mn>2</mn></math> be.</p><p>So.</p>", ["Let x+2 be.", "So."]),
        ("<p>One <math/> two.</p><p>Three.</p>", ["One two.", "Three."]),
        ("<p>One <svg><g> two.</p><p>Three.</p>", ["One two.", "Three."]),
        ("<svg><p>One.</p><p>Two.</p>", ["One.", "Two."]),
        ("<svg><foreignObject><p>One.</p><p>Two.</svg><p>Three.", ["One.", "Two.", "Three."]),
        ('<p>One <object data="x"><param name="a">other</object> two.</p><p>Three.</p>', ["One other two.", "Three."]),
        ('<p>One <object data="x"> two.</p><p>Three.</p>', ["One two.", "Three."]),
        ('<p>One <object data="x"/> two.</p><p>Three.</p>', ["One two.", "Three."]),
        ("<p>One <noscript>still</noscript> two.</p><noscript><p>Three.</noscript><p>Four.", ["One still two.", "Three.", "Four."]),
        ('<p>One <iframe src="x"/> two.</p><p>Three.</p>', ["One two.", "Three."]),
        ("<p>One <iframe src=http://x/>gone</iframe> two.</p>", ["One two."]),
        ("<p>One <template><p>gone</template><script/>gone</script> two.", ["One two."]),
        ("<style-guide>One.</style-guide><p>Two.", ["One.", "Two."]),
    ],
)
def test_elements_in_an_article(inner, texts):
    assert [b.text for b in extraction.blocks(f"<article>{inner}</article>")] == texts
    head = "<head><title>T</title><noscript><style>x</style>y</noscript></head><body>"
    assert [b.text for b in extraction.blocks(f"{head}<article>{inner}")] == ["T", *texts]


def test_page_query_on_the_tables(spark, sf_dir):
    rows = QUERIES["op8_page_text"](spark, sf_dir).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    assert {r["page_id"] for r in rows} == set(pages)
    import html
    import re

    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.DOTALL)[1]
        parts = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " "))
        wanted = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert r["text"] == "\n".join(x for x in wanted if x)
