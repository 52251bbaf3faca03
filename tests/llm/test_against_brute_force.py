"""Each operator against a brute-force version, an exact round trip, held-out labels or DuckDB."""

from __future__ import annotations

import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from evidra.llm import editdist, op1_packing, op2_quality, op3_minhash, op4_mixing, op5_topk, op6_html, op7_line_dedup, op9_sharding, oracles, queries

TABLES = "documents embeddings pages labels".split()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    want = con.sql(oracles.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_special_tokens_in_texts(spark):
    """Ids as an untouched tokenizer gives them."""
    texts = ["see <|endoftext|> here", "<|endoftext|>", "the end.<|endoftext|>More", "<|endoftext", "é😀<|endoftext|>ß"]
    plain, own = _tokenizer(), op1_packing.encoder()
    assert [own(t) for t in texts] == [plain.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in own(texts[0])
    got = op1_packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        ids = [*plain.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.length, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_packing(spark, sf):
    plain = _tokenizer()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, i] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    got = queries.op1_best_fit_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for inside in places.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= 2048
    # no more than plain best-fit decreasing uses
    left: list[int] = []
    for n in sorted((w[1] for w in want.values()), reverse=True):
        fit = min((x for x in left if x >= n), default=None)
        if fit is None:
            left.append(2048 - n)
        else:
            left[left.index(fit)] -= n
    assert len(places) <= len(left)


def test_packing_keeps_every_limit():
    limits = op1_packing.Limits(tokens=100, documents=4, attention=3000)
    for rule in ("norm", "dot"):
        counts = {n: random.Random(n).randrange(1, 40) for n in range(1, 50, 3)}
        rows = op1_packing.plan(counts, op1_packing.Limits(limits.tokens, limits.documents, limits.attention, rule=rule))
        bins = defaultdict(list)
        for length, rank, first, k, offset, taken in rows.tolist():
            for step in range(taken):
                bins[first + step // k].append((offset + step % k * length, length))
        assert Counter(n for b in bins.values() for _, n in b) == Counter(counts)
        for b in bins.values():
            assert len(b) <= 4 and sum(n for _, n in b) <= 100 and sum(n * n for _, n in b) <= 3000
            at = 0
            for offset, n in sorted(b):
                assert offset == at
                at += n


def test_coders_agree():
    e, draw = op1_packing.encoder(), random.Random(1)
    for _ in range(4000):
        text = "".join(draw.choice([chr(draw.randrange(0x250)), draw.choice(" \n\t  'sdl09aé.")]) for _ in range(draw.randrange(1, 25)))
        assert e.fast.encode_ordinary(text) == e.exact.encode(text, add_special_tokens=False).ids


def test_quality(spark, sf):
    where = sf.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    got = queries.op2_quality_classifier(spark, where).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum((s >= 0.5) == y for s, y in held) / len(held) > 0.97
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_fourier_features_approximate_a_gaussian_kernel():
    draw = np.random.default_rng(3)
    width, features = len(op2_quality.NAMES), 20_000
    weights, shift = draw.standard_normal((width, features)) / np.sqrt(2 * width), draw.uniform(0, 2 * np.pi, features)
    z = draw.standard_normal((12, width))
    maps = op2_quality.fourier(z, weights, shift)[:, 1:] / op2_quality.SCALE
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (4 * width))
    assert np.abs(2 * maps @ maps.T / features - kernel).max() < 0.05


def test_the_fit_against_plain_equations(spark, sf):
    """Whole-table ridge regression in one array, with penalties tried on halves, against the sums of partitions."""
    where = sf.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    model = op2_quality.fit(op2_quality.described(docs.repartition(7)), labels)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    rest = lambda i: zlib.crc32(str(i).encode()) % 3
    rows = [(op2_quality.statistics(r.text), quality[r.doc_id], rest(r.doc_id)) for r in docs.collect() if quality.get(r.doc_id) in (0, 1) and rest(r.doc_id) != 1]
    x, y, half = (np.array(c, float) for c in zip(*rows))
    assert np.allclose(model.mean, x.mean(0), atol=1e-5) and np.allclose(model.spread[x.std(0) > 1e-5], x.std(0)[x.std(0) > 1e-5], atol=1e-5)
    z = op2_quality.fourier((x - model.mean) / model.spread, model.weights, model.shift) / op2_quality.SCALE

    def solved(rows, penalty):
        ridge = np.diag([1e-12, *[penalty] * (z.shape[1] - 1)])
        return np.linalg.solve(z[rows].T @ z[rows] / rows.sum() + ridge, z[rows].T @ y[rows] / rows.sum())

    halves = [half == 0, half == 2]
    loss = {p: sum(((z[b] @ solved(a, p) - y[b]) ** 2).sum() for a, b in (halves, halves[::-1])) for p in op2_quality.PENALTIES}
    best = min(loss, key=loss.get)
    assert np.allclose(z @ model.beta, z @ solved(half >= 0, best), atol=1e-6)
    crossed = np.where(half == 0, z @ solved(halves[1], best), z @ solved(halves[0], best))
    bins = np.floor((crossed.clip(-0.5, 1.5) + 0.5) / 2 * op2_quality.BINS)
    at = np.unique(bins)
    knots, levels = op2_quality.isotonic((at + 0.5) / op2_quality.BINS * 2 - 0.5, np.array([y[bins == b].sum() for b in at]), np.array([(bins == b).sum() for b in at], float))
    assert np.allclose(model.curve[0], knots) and np.allclose(model.curve[1], levels)


def test_isotonic_curve_against_the_minimax_formula():
    draw = np.random.default_rng(8)
    for _ in range(30):
        n = draw.integers(1, 6, 25).astype(float)
        k = np.array([draw.integers(0, c + 1) for c in n], float)
        mean = lambda i, j: k[i : j + 1].sum() / n[i : j + 1].sum()  # noqa: E731, B023
        want = [max(min(mean(i, j) for j in range(m, 25)) for i in range(m + 1)) for m in range(25)]
        knots, levels = op2_quality.isotonic(np.arange(25.0), k, n)
        # blocks of equal means, one knot each
        blocks = [0, *[m for m in range(1, 25) if abs(want[m] - want[m - 1]) > 1e-12], 25]
        assert len(knots) == len(blocks) - 1
        for a, b, level in zip(blocks, blocks[1:], levels):
            assert abs(level - (k[a:b].sum() + 0.5) / (n[a:b].sum() + 1)) < 1e-12


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    """Targets by sharing the excess out until nobody is above the cap; documents near them."""
    draw = random.Random(seed)
    names = [None, "", "a", "B", "é", "😀", *(f"s{i}" for i in range(20))]
    size = {n: draw.choice([0, 1, 5, 5, 40, 300, 2000]) for n in names}
    rows = [(i * 100 + k, "w " * (size[n] // 10 if k < 10 else size[n] % 10), n) for i, n in enumerate(names) for k in range(11)]
    weight = {n: i % 3 + 1 for i, n in enumerate([*sorted(n for n in names if n is not None), None])}
    total, free, want = sum(size.values()), set(names), {}
    while free:
        level = (total - sum(want.values())) / sum(weight[n] for n in free)
        over = {n for n in free if weight[n] * level > 3 * size[n]}
        want |= {n: 3.0 * size[n] for n in over} if over else {n: weight[n] * level for n in free}
        free = free - over if over else set()
    got = op4_mixing.plan_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[n] - want[n]) <= size[n] // 10 * 10 + 10 for n in names)
    mixed = Counter(r.doc_id for r in op4_mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect())
    assert all(mixed[r.doc_id] == r.copies for r in got)


def _best(rows, k=5, scale=256):
    """(query, rank, id, score) of rows (id, vector) in integers of any size."""
    v = [(i, [int(np.floor(scale * float(x))) for x in e]) for i, e in rows]
    want = []
    for q in sorted({i for i, _ in v if i % 50 == 0}):
        scores = sorted((-sum(a * b for a, b in zip(x, y)), j) for i, x in v if i == q for j, y in v if j != q and len(x) == len(y))[:k]
        want += [(q, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return sorted(want)


def _small_blocks(monkeypatch):
    for name, value in (("BLOCK", 40), ("LANES", 3), ("IN_LANE", 2), ("QUERIES", 4), ("FIRST", 1)):
        monkeypatch.setattr(op5_topk, name, value)


@pytest.mark.parametrize("scale", [1.0, 1e5, 1e6])
def test_search_over_many_blocks(spark, monkeypatch, scale):
    _small_blocks(monkeypatch)
    draw = np.random.default_rng(4)
    v = np.round(draw.standard_normal((700, 6)), 1).astype(np.float32) * np.float32(scale)
    v[600:] = v[:100]  # copies
    rows = [(i, [float(x) for x in v[i]]) for i in range(700)]
    got = op5_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _best(rows)


def test_search_with_hot_vectors_lengths_and_repeated_ids(spark, monkeypatch):
    _small_blocks(monkeypatch)
    draw = np.random.default_rng(5)
    rows = [(i, [0.5, 0.25, -1.0]) for i in range(200)] + [(i, [float(x) for x in draw.standard_normal(3).round(2)]) for i in range(200, 420)]
    rows += [(i, [float(x) for x in draw.standard_normal(2).round(2)]) for i in range(420, 460)]
    rows += [(50, [0.1, 0.2, 0.3]), (100, [0.5, 0.25, -1.0]), (7, [0.5, 0.25, -1.0]), (7, [2.0, 2.0, -2.0]), (450, [1.0, 1.0])]
    got = op5_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _best(rows)


def test_search_reads_few_exact_vectors(spark):
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in draw.standard_normal(32)]) for i in range(3000)]
    found, read = op5_topk.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == _best(rows)
    assert read[0]["possible"] < 0.02 * read[0]["queries"] * read[0]["classes"]


def test_scores_that_are_no_long(spark):
    rows = [(0, [7e6, 7e6]), (1, [7e6, 7e6 - 1]), (2, [-7e6, 7e6]), (3, [-7e6, -7e6])]  # just within
    got = op5_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == _best(rows)
    for big in (3e15, 1e30):
        with pytest.raises(Exception, match="64-bit integer"):
            op5_topk.top_k(spark.createDataFrame([(0, [big, big]), (1, [big, big])], "vec_id long, embedding array<double>")).collect()


def _near_copies(n: int = 60) -> list[tuple[int, str]]:
    """A group whose links form chains, copies, unrelated texts and texts that share a passage."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(120)]
    passage = [word() for _ in range(60)]
    out = []
    for i in range(n):
        words = base[:]
        for _ in range(draw.randrange(0, 5)):
            words[draw.randrange(len(words))] = word()
        out.append((i, " ".join(words)))
    out += [(n + i, " ".join(passage + [word() for _ in range(40)])) for i in range(30)]
    out += [(n + 30 + i, out[i * 2][1].upper()) for i in range(10)] + [(n + 40 + i, " ".join(word() for _ in range(80))) for i in range(10)]
    return out


@pytest.mark.parametrize("few,block", [(24, 512), (2, 7)])
def test_near_duplicates(spark, monkeypatch, few, block):
    monkeypatch.setattr(op3_minhash, "FEW", few)
    monkeypatch.setattr(op3_minhash, "BLOCK", block)
    rows = _near_copies()
    sets = {i: {tuple(w[k : k + 5]) for w in [t.lower().split()] for k in range(len(w) - 4)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = op3_minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in sets}
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(s) for i, s in sets.items()}
    assert {r.doc_id for r in got if r.kept} == {i for i in sets if find(i) == i}


def test_signatures_find_pairs_at_the_threshold():
    """Pairs of similarity 0.8 share a band and agree in as many coordinates as the last round asks for."""
    draw = np.random.default_rng(11)
    least, similar = op3_minhash._alike(80), 0
    for n in (5, 20, 60, 400, 3000):
        for _ in range(120):
            both, own = round(0.8 * n), n - round(0.8 * n)
            found = draw.integers(0, 1 << 63, both + own, dtype=np.uint64)
            a, b = np.sort(found[: both + own // 2]), np.sort(np.concatenate([found[:both], found[both + own // 2 :]]))
            assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
            one, two = op3_minhash.signature(a), op3_minhash.signature(b)
            assert (op3_minhash.bands(one) == op3_minhash.bands(two)).any()
            similar += (one.astype(np.uint8) == two.astype(np.uint8)).sum() >= least
    assert similar == 600


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edited(draw: random.Random, text: str, edits: int) -> str:
    out = list(text)
    for _ in range(edits):
        kind, i = draw.randrange(3), draw.randrange(len(out))
        if kind == 0:
            out.insert(i, draw.choice("abcdé"))
        elif kind == 1:
            out[i] = draw.choice("abcdé")
        elif len(out) > 1:
            del out[i]
    return "".join(out)


def test_edit_distance():
    draw = random.Random(3)
    for _ in range(3000):
        a = "".join(draw.choice("abcd") for _ in range(draw.choice([1, 3, 8, 20, 70])))
        b, most = _edited(draw, a, draw.randrange(6)), draw.randrange(5)
        d = _distance(a, b)
        assert editdist.distance_within(a, b, most) == (d if d <= most else None)


TIERS = ((20, 1), (32, 2), (45, 4))


@pytest.mark.parametrize("few,edits,block", [(16, 2, 5), (1, 2, 5), (1, 2, 1000), (16, 1, 5), (16, TIERS, 5), (1, TIERS, 5)])
def test_line_dedup(spark, monkeypatch, few, edits, block):
    monkeypatch.setattr(op7_line_dedup, "FEW", few)
    monkeypatch.setattr(op7_line_dedup, "BLOCK", block)
    draw = random.Random(9)
    least = 20 if edits is TIERS else 32
    base = ["".join(draw.choice("abcdefgh ") for _ in range(draw.randrange(18, 60))).strip() for _ in range(20)]
    rows = [(i, "\n".join(_edited(draw, draw.choice(base), draw.randrange(6)) if draw.random() < 0.8 else draw.choice(["short", " short", "", " ", "x" * 40, "y"]) for _ in range(6))) for i in range(40)]
    first: dict[str, tuple[int, int]] = {}
    lines = [(i, n, x.strip()) for i, t in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    for i, n, x in lines:
        first.setdefault(x, (i, n))

    def close(x, y):
        n = min(len(x), len(y))
        most = edits if isinstance(edits, int) else max([k for at, k in edits if at <= n], default=0)
        return n >= least and abs(len(x) - len(y)) <= most and _distance(x, y) <= most

    near = {x for x in first for y in first if first[y] < first[x] and close(x, y)}
    gone = defaultdict(set)
    for i, n, x in lines:
        if x in near or first[x] != (i, n):
            gone[i].add(n)
    want = {}
    for i, t in rows:
        kept = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        if kept.strip() or not gone[i]:
            want[i] = kept
    got = op7_line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), edits, least)
    assert {r.doc_id: r.text for r in got.collect()} == want and near


def test_html(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op6_html_extraction(spark, sf).collect():
        inside = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inside))
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_html_without_an_article():
    page = """<body><header><h1>Site</h1><nav>Menu</nav></header><div id="wrapper"><div class="sidebar"><p>side</p></div><div class="post-content"><h1>Title &amp; more</h1>
      <p>One &lt;b&gt; <a href="x">two</a>.<ul><li>A<li>B</ul><div class="share-buttons">Share</div><p>End.</div><section class="comments"><p>A long reader comment, longer than all else that stands on this page, to be sure.</p></section></div><footer>f</footer>"""
    assert op6_html.chosen(page) == "Title & more\nOne <b> two.\nA\nB\nEnd."


def test_consensus(spark):
    """A page whose sidebar is longer than its text is read by the path of its host."""
    good = "<body><div class='left-{0}'><p>{1}</p></div><div class='main-col-{0}'><p>{2}</p></div></body>"
    rows = [(i, "http://h.example/p", good.format(i, "short", "the text " * 30)) for i in range(5)] + [(9, "http://h.example/q", good.format(9, "x " * 45, "the text " * 9))]
    got = {r.page_id: r.text for r in op6_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == ("the text " * 9).strip() and got[0] == ("the text " * 30).strip()


@pytest.mark.parametrize("page,lines", [
    ("<div>" * 100_000 + "deep", ["deep"]),
    ("<p>one</p><svg/><p>two</p>", ["one", "two"]),
    ("<svg><p>one</p><p>two</p>", ["one", "two"]),
    ("<svg><path/><text>no</text></svg><p>one</p><math/><p>two</p>", ["one", "two"]),
    ("<title>no<p>one</p><p>two</p>", ["one", "two"]),
    ("<p>one</p><script>no<p>two</p>", ["one", "two"]),
    ("<script>no('</p>')</script><p>one</p><style>no", ["one"]),
    ("<nav>no <article><p>one</p></article>", ["one"]),
    ("<p>one</p><noscript>no<p>two</p>", ["one", "two"]),
])
def test_markup_that_would_swallow_the_page(page, lines):
    assert op6_html.chosen(page).split("\n") == lines


@pytest.mark.parametrize("name", ["class='legal-news'", "id='print'", "class='rail'", "class='follow'", "class='reply'", "class='notice'", "class='trending'", "class='hidden'", "class='page has-sidebar'"])
def test_names_do_not_hide_main_text(name):
    page = f"<body><div {name}><p>{'Some words of the text. ' * 20}</p></div><div class='notice'>We use cookies.</div></body>"
    assert op6_html.chosen(page) == ("Some words of the text. " * 20).strip()


def test_an_article_in_two_containers():
    parts = ["The first part says this. " * 12, "The second part says that. " * 5]
    page = f"<body><nav><a href='/'>Home</a></nav><div class='lead-1'><p>{parts[0]}</p></div><div class='more'><p>{parts[1]}</p></div><footer>f</footer></body>"
    assert op6_html.chosen(page) == "\n".join(x.strip() for x in parts)


def _host_pages(draw: random.Random, host: str, n: int):
    """Pages without an article element, of one template, and their main texts."""
    say = lambda k: " ".join("".join(draw.choice("abcdefgh") for _ in range(draw.randrange(2, 9))) for _ in range(k)) + "."
    about, tip = say(40), say(25)
    for i in range(n):
        body = [say(draw.randrange(20, 60)) for _ in range(draw.randrange(2, 6))]
        split = draw.randrange(len(body) + 1) if draw.random() < 0.3 else len(body)
        inner = "".join(f"<p>{x}</p>" for x in body[:split])
        rest = "".join(f"<p>{x}</p>" for x in body[split:])
        talk = "".join(f"<p>{say(30)}</p>" for _ in range(draw.randrange(6)))
        yield f"http://{host}/{i}", (
            f"<body><div class='top'><a href='/'>Home</a> <a href='/b'>News</a> <a href='/c'>More</a></div><div class='c{draw.randrange(9)}'>{inner}</div>"
            + (f"<div class='part'>{rest}</div>" if rest else "")
            + f"<div class='x1'><p>{about}</p></div><div class='x2'><p>{tip}</p></div><div id='comments'>{talk}</div><div class='links'><a href='/d'>{say(4)}</a><a href='/e'>{say(4)}</a><a href='/f'>{say(5)}</a></div></body>"
        ), body


def test_votes_find_the_main_text_without_article_elements(spark):
    """Unnamed boxes that repeat on a host go, parts of the text that only some pages have stay."""
    draw = random.Random(2)
    pages = [p for h in range(6) for p in _host_pages(draw, f"h{h}.example", 25)]
    rows = [(i, url, page) for i, (url, page, _) in enumerate(pages)]
    got = {r.page_id: Counter(r.text.split("\n")) for r in op6_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i: Counter(body) for i, (_, _, body) in enumerate(pages)}
    right = sum((got[i] & want[i]).total() for i in want)
    assert right / sum(c.total() for c in want.values()) > 0.97  # recall, in blocks
    assert right / sum(c.total() for c in got.values()) > 0.97  # precision
    alone = [op6_html.chosen(page) for _, page, _ in pages]
    assert right / sum(len(x.split("\n")) for x in alone) < 0.8  # without votes the boxes stay


def test_sharding():
    table = op9_sharding.fill_table(op9_sharding.SHARDS, 4099)
    loads = Counter(table)
    assert max(loads.values()) - min(loads.values()) <= 1
    fewer = op9_sharding.fill_table(op9_sharding.SHARDS[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer) if a != len(op9_sharding.SHARDS) - 1)
    assert moved < 0.2 * 4099
    with pytest.raises(ValueError):
        op9_sharding.fill_table(("a", "a"), 13)
