"""The operators against brute force, libraries and held-out labels."""

import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplypanel.llm import (
    decontamination,
    near_vectors,
    ngram_join,
    packing,
    sharding,
    token_counts,
    toxicity,
    url_filter,
    wrappers,
)
from supplypanel.llm.common import components
from supplypanel.llm.words import word_hashes

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz ar el in on un ta te ti to tu".split()


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def test_token_counts_agree_with_the_library():
    from tokenizers import Tokenizer, models

    rng = random.Random(1)
    pieces = token_counts.read_pieces(token_counts.vocabulary_path())
    library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    own = token_counts.Counter(pieces)
    for _ in range(300):
        text = "".join(rng.choice("ab c\n\té▁語😀\r{ the") for _ in range(rng.randint(1, 80)))
        marked = "▁" + text.replace(" ", "▁")
        assert own(text) == len(library.encode(marked).ids), text


def test_token_counts_break_ties_as_the_library_does():
    from tokenizers import Tokenizer, models

    for seed in range(60):
        rng = random.Random(seed)
        names = {
            rng.choice("ab▁") + "".join(rng.choice("ab") for _ in range(rng.randint(0, 3))) for _ in range(10)
        }
        pieces = [("<unk>", 0.0), *((n, -float(rng.randint(1, 3))) for n in sorted(names))]
        library = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=False))
        own = token_counts.Counter(pieces)
        for _ in range(20):
            text = "".join(rng.choice("abc \n") for _ in range(rng.randint(1, 30)))
            assert own(text) == len(library.encode("▁" + text.replace(" ", "▁")).ids), (pieces, text)


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    out = sharding.op2_sharding(spark, MEDIUM).toPandas()
    docs = table(spark, MEDIUM, "documents").toPandas().set_index("doc_id")["text"]
    for r in out.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    moved = out[out.shard != out.grown_shard]
    assert set(moved.grown_shard) == {24} and 10 < len(moved) < 90
    for _, rows in out.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))
    assert set(out.shard) == set(range(24))


def test_weights_confine_movement(spark):
    before = (((1.0, 2.0), (1.0,)), ((3.0, 1.0),))
    after = (((1.0, 4.0), (1.0,)), ((3.0, 1.0),))
    ids = spark.range(40_000)
    rows = ids.select(
        sharding.shard_of(ids.id, before).alias("a"), sharding.shard_of(ids.id, after).alias("b")
    ).toPandas()
    share = rows.a.value_counts(normalize=True)
    assert share.loc[[0, 1, 2, 3, 4]].tolist() == pytest.approx([1 / 8, 2 / 8, 1 / 8, 3 / 8, 1 / 8], abs=0.01)
    # shard 1, its rack and its region grew: rows move into these, none to the other region
    assert rows[(rows.a != rows.b) & rows.b.isin([3, 4])].empty


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    out = toxicity.op3_toxicity(spark, folder).toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert ((out.score >= 0.5) == (out.predicted == 1)).all() and out.score.between(0, 1).all()
    known = out.merge(table(spark, folder, "labels").toPandas(), on="doc_id")
    known = known[known.held_out]
    hit = ((known.predicted == 1) & (known.toxic == 1)).sum()
    assert hit >= 0.9 * (known.toxic == 1).sum()
    assert hit >= 0.9 * (known.predicted == 1).sum()


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    return lower, re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_filter_against_plain_rules(spark):
    out = url_filter.op4_url_filter(spark, MEDIUM).toPandas().set_index("page_id")
    urls = table(spark, MEDIUM, "pages").select("page_id", "url").toPandas()
    rules = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    spam = ("pills", "casino", "adult-x", "free-bets", "ads-track", "spam-farm")
    for page_id, url in zip(urls.page_id, urls.url):
        host, path = plain_url(url)
        fit = [
            (len(name), name, verdict)
            for name, verdict in rules
            for own, prefix in [name.split("/", 1)]
            if (host == own or host.endswith("." + own)) and path.startswith("/" + prefix)
        ]
        row = out.loc[page_id]
        assert (row.host, row.path) == (host, path)
        if fit:
            assert (row.rule, row.verdict) == max(fit)[1:]
        else:
            assert row.rule is None
            assert row.verdict == ("block" if any(s in host for s in spam) else "allow"), url


def noisy(rng, words, share):
    return [rng.choice(WORDS) + rng.choice(WORDS) if rng.random() < share else w for w in words]


def near_texts():
    """Groups of near copies around the threshold, short texts, shared passages."""
    rng = random.Random(5)
    texts = []
    passage = [rng.choice(WORDS) for _ in range(12)]
    for _ in range(25):
        base = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.choice([3, 5, 9, 20, 60, 200, 900]))]
        for _ in range(rng.randint(1, 12)):
            own = noisy(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05]))
            texts.append(" ".join(own + (passage if rng.random() < 0.3 else [])))
    return texts + ["", None, " \n", texts[0], texts[0].upper()]


@pytest.mark.parametrize("n, threshold", [(4, 85), (5, 80)])
def test_ngram_join_against_all_pairs(spark, n, threshold):
    texts = near_texts()
    sets = {}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets[i] = {tuple(words[j : j + n]) for j in range(max(len(words) - n + 1, 1))} if words else set()
    parent = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    found = ngram_join.near_duplicates(docs, n=n, threshold=threshold).collect()
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in found}
    assert out == {i: (len(s), find(parent, i)) for i, s in sets.items()}
    assert len({c for _, c in out.values()}) < len(texts) - 20


@pytest.mark.parametrize("threshold", [80, 85])
def test_linked_sets_meet_in_a_band(spark, threshold):
    sizes = [(s,) for s in range(1, 700)]
    df = spark.createDataFrame(sizes, "n bigint").withColumn("number", F.lit(7).cast("long"))
    bands = {
        r.n: set(r.b)
        for r in df.select("n", ngram_join.band_numbers("number", "n", threshold).alias("b")).collect()
    }
    for size in range(1, 550):
        for other in range(size, min(100 * size // threshold, 699) + 1):
            assert bands[size] & bands[other], (size, other)


@pytest.mark.parametrize("threshold", [80, 85])
def test_linked_sets_share_a_rare_ngram(threshold):
    rng = np.random.default_rng(6)
    weights = rng.integers(0, 4, ngram_join.COUNTERS).astype(np.uint8)
    for _ in range(300):
        common = rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)
        two = []
        for _ in range(2):
            own = rng.integers(0, 2**63, rng.integers(0, 1 + len(common) // 8)).astype(np.uint64)
            two.append(np.unique(np.concatenate([common, own])))
        a, b = two
        both = len(np.intersect1d(a, b))
        if 100 * both >= threshold * (len(a) + len(b) - both):
            x, y = (ngram_join.prefix(s, weights, threshold) for s in two)
            assert len(np.intersect1d(x, y)), (len(a), len(b))


def test_ngram_join_of_very_long_texts(spark):
    """A million distinct n-grams and a copy with one word changed; an unrelated text as long."""
    one = [f"w{i}" for i in range(1_000_000)]
    two = [*one[:500_000], "changed", *one[500_001:]]
    rows = [(1, " ".join(one)), (2, " ".join(two)), (3, " ".join(f"v{i}" for i in range(1_000_000)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs, n=5, threshold=80).collect()}
    assert out == {1: (999_996, 1), 2: (999_996, 1), 3: (999_996, 3)}


def test_ngram_join_with_a_passage_that_many_share(spark):
    """Unrelated texts with a common passage, alone in some of them, are not paired."""
    rng = random.Random(8)
    passage = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(40))
    texts = [passage + " " + " ".join(f"x{i}y{k}" for k in range(30)) for i in range(400)]
    texts += [passage] * 5 + [passage + f" z{i}" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    out = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(docs).collect()}
    assert out == {i: i if i < 400 else 400 for i in range(len(texts))}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 600)]
    parent = {i: i for e in edges for i in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    out = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    linked = {i for a, b in edges if a != b for i in (a, b)}
    assert {r.node: r.component for r in out} == {i: find(parent, i) for i in linked}


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for size in (1, 1, 2, 5, 40, 300):
        for _ in range(4):
            center = rng.normal(size=16)
            rows += [center + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2]) for _ in range(size)]
    rows += rows[:20]
    vectors = np.array(rows, dtype=np.float32)
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>"
    )
    out, recall = near_vectors.near_vectors(df)
    out = out.toPandas().set_index("vec_id")
    assert recall >= 0.9
    found = out.n_links.loc[range(len(rows))].to_numpy()
    assert (found <= link.sum(1)).all() and found.sum() >= 0.97 * link.sum()
    assert (out.kept == (out.index == out.component_id)).all()


def groups_of_near_copies(spark, groups, size):
    """Tight groups (inner cosine over 0.998) in a row, each at cosine 0.96 to the next."""
    rng = np.random.default_rng(8)
    angle = math.acos(0.96)
    rows = []
    for k in range(groups):
        center = np.zeros(32)
        center[:2] = math.cos(k * angle), math.sin(k * angle)
        rows += [center + 0.004 * rng.normal(size=32) for _ in range(size)]
    vectors = np.array(rows)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    link = vectors @ vectors.T >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>"
    )
    return df, link


@pytest.mark.parametrize("groups, size", [(2, 12), (3, 150)])
def test_near_vectors_link_saturated_groups(spark, groups, size):
    df, link = groups_of_near_copies(spark, groups, size)
    assert link[0, :size].sum() == size - 1 and link[0, size : 2 * size].any()
    out, recall = near_vectors.near_vectors(df)
    out = out.toPandas().set_index("vec_id").sort_index()
    assert set(out.component_id) == {0} and out.index[out.kept].tolist() == [0]
    assert out.n_links.tolist() == link.sum(1).tolist() and recall == 1


def test_near_vectors_are_compared_one_by_one_if_audits_fail(spark, monkeypatch):
    df, link = groups_of_near_copies(spark, 3, 12)
    monkeypatch.setattr(near_vectors, "_recall", lambda *_: 0.0)
    monkeypatch.setattr(near_vectors, "BLOCK", 8)
    monkeypatch.setattr(near_vectors, "_joined_parts", lost_links)
    out, _ = near_vectors.near_vectors(df)
    out = out.toPandas().set_index("vec_id").sort_index()
    assert set(out.component_id) == {0} and out.n_links.tolist() == link.sum(1).tolist()


def lost_links(nodes, edges, threshold, k):
    """Components of a search that finds no link between groups."""
    close = edges.where(f"c >= {threshold}")
    return near_vectors.written(components(close, "u", "v"), "components")


def test_html_extraction_of_the_pages(spark):
    import html

    pages = table(spark, MEDIUM, "pages").toPandas()
    from supplypanel.llm.html_extraction import op8_html_extraction

    out = op8_html_extraction(spark, MEDIUM).toPandas().set_index("page_id")
    for page_id, source in zip(pages.page_id, pages.html):
        article = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [re.sub("<[^>]*>", " ", p) for p in re.split(r"</?(?:p|h1)>", article)]
        lines = [" ".join(html.unescape(p).split()) for p in parts]
        expected = "\n".join(x for x in lines if x)
        assert (out.text[page_id], out.n_chars[page_id]) == (expected, len(expected))


def test_wrappers_without_an_article_element():
    def page(i):
        more = "".join(f"<p>more {i} {k}</p>" for k in range(i % 3))
        notice = "<div class='notice'>closed today</div>" if i % 2 else ""
        return (
            f"<body><div><a href=/>Home</a> <a href=/n>News</a></div>{notice}<div><h1>Title {i}</h1>"
            f"<p>story {i} of the day</p>{more}</div><div>Copyright Example Press</div></body>"
        )

    own = None
    for i in range(6):
        new = wrappers.page_wrapper(wrappers.page_tree(page(i)))
        own = wrappers.merge(own, new) if own else new
    for i in range(6):
        expected = [f"Title {i}", f"story {i} of the day", *(f"more {i} {k}" for k in range(i % 3))]
        assert wrappers.blocks(wrappers.page_tree(page(i)), own) == expected


def test_template_texts_inside_the_article():
    def page(i):
        line = "<div class='zq'><p>Get our letter</p></div>" if i % 4 else ""
        return (
            f"<article><h1>Title {i}</h1><p>story {i}</p>{line}<p>more {i}</p>"
            f"<section class='k7'>Made by the Example Press</section></article>"
        )

    trees = [wrappers.page_tree(page(i)) for i in range(8)]
    own = wrappers.page_wrapper(trees[0])
    for tree in trees[1:]:
        own = wrappers.merge(own, wrappers.page_wrapper(tree))
    for i, tree in enumerate(trees):
        assert wrappers.blocks(tree, own) == [f"Title {i}", f"story {i}", f"more {i}"]
    # an article that pages repeat whole is no template
    same = wrappers.page_tree("<article><h1>Title</h1><p>story</p></article>")
    own = [5, wrappers.page_wrapper(same)[1]]
    for _ in range(4):
        own = wrappers.merge(own, wrappers.page_wrapper(same))
    assert wrappers.blocks(same, own) == ["Title", "story"]


@pytest.mark.parametrize("copies", [3, 1000])
def test_copies_of_a_page_are_no_template(spark, copies):
    from supplypanel.llm.html_extraction import extract

    def page(k):
        return f"<body><div class=zz>Example Press</div><h1>Title {k}</h1><p>story {k}</p></body>"

    own = "<body><div class=zz>Example Press</div><h2 class=o>Own title</h2><section>Own story</section></body>"
    rows = [(i, "http://a.b/", "<body><h1>Only</h1><div><p>one page</p></div></body>") for i in range(copies)]
    rows += [(-1 - i, "http://c.d/", own) for i in range(copies)]
    rows += [(10_000 + i, "http://c.d/", page(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    out = {r.page_id: r.text for r in extract(df, "page_id").collect()}
    assert {out[i] for i in range(copies)} == {"Only\none page"}
    assert {out[-1 - i] for i in range(copies)} == {"Own title\nOwn story"}
    assert [out[10_000 + i] for i in range(6)] == [f"Title {i}\nstory {i}" for i in range(6)]


def test_long_sequences_are_aligned_as_short_ones():
    rng = random.Random(3)
    for n, m in ((0, 4), (7, 9), (60, 50), (150, 190), (420, 390)):
        a, b = ([rng.choice("abcdef") for _ in range(k)] for k in (n, m))
        length = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                best = max(length[i][j + 1], length[i + 1][j])
                length[i + 1][j + 1] = length[i][j] + 1 if a[i] == b[j] else best
        pairs = list(wrappers._common(a, b))
        assert len(pairs) == length[n][m] and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_wrapper_of_repeated_groups():
    def shape(source):
        return wrappers.page_wrapper(wrappers.page_tree(source))

    one = shape("<dl><dt>a<dd>b<dt>c<dd>d</dl>")
    two = shape("<dl><dt>e<dd>f</dl><hr>")
    dl, hr = wrappers.merge(one, two)[1]
    assert (dl[0], dl[1], hr[0], hr[1]) == ("dl", 2, "hr", 1)  # the rule is optional
    (group,) = dl[3]
    assert group[0] == wrappers.GROUP and [i[0] for i in group[3]] == ["dt", "dd"]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<article><h1>T</h1><p>a<br>b<p>c <b>d<div class='comments'><p>no</div></article>", ["T", "a b", "c d"]),
        ("<main><p>x &lt;y&gt; &#233;</p><aside>no</aside><form>no</form></main><footer>no", ["x <y> é"]),
        ("<header>no</header><article><header><h1>T</h1></header>x<script>'</article>'</script></article>", ["T", "x"]),
        ("<p title='a>b'>1 < 2 && 3<!-- no --></p><p hidden>", ["1 < 2 && 3"]),
        ("<nav>no</nav><div id='cookie-banner'>no</div><div class='post-content'>yes</div>", ["yes"]),
    ],
)
def test_single_pages(source, expected):
    tree = wrappers.page_tree(source)
    assert wrappers.blocks(tree, wrappers.page_wrapper(tree)) == expected


def test_encoder_agrees_with_the_tokenizer():
    encoder = packing.Encoder(*packing.vocabulary_paths())
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab c.,'1é\n \t語I'll") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    for text in [*texts, "<|endoftext|> b", "a  b\n\nc ", "I'll we're\nx, y. z"]:
        expected = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder(text), dtype="<u4").tolist() == expected, text


def test_packing_round_trip(spark):
    out = packing.op9_best_fit_packing(spark, MEDIUM).toPandas()
    encoder = packing.Encoder(*packing.vocabulary_paths())
    texts = table(spark, MEDIUM, "documents").toPandas().set_index("doc_id")["text"]
    for doc_id, rows in out.groupby("doc_id"):
        ids = encoder.tokenizer.encode(texts[doc_id], add_special_tokens=False).ids + [2]
        at = 0
        for r in rows.sort_values("piece").itertuples():
            own = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.start == at and r.ids_crc32 == zlib.crc32(own.tobytes())
            assert r.length == 1024 or r.piece == 0
            at += r.length
        assert at == len(ids)
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]]
        assert rows.length.sum() <= 1024
    fewest = math.ceil(out.length.sum() / 1024)
    assert out.sequence_id.nunique() <= fewest * 1.005 + 1


def best_packing(items, capacity):
    """The fewest bins, by trying every bin for every item."""
    best = len(items)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in sorted({b for b in bins if b + items[i] <= capacity}):
            rest = list(bins)
            rest.remove(k)
            place(i + 1, [*rest, k + items[i]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(2)
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        patterns = packing.bin_completion(Counter(items), 20)
        used = Counter()
        for lengths, times in patterns:
            assert sum(lengths) <= 20
            for n in lengths:
                used[n] += times
        assert used == Counter(items)
        bins = sum(times for _, times in patterns)
        assert packing.lower_bound(Counter(items), 20) <= best_packing(items, 20) == bins, items


def test_bin_completion_goes_back_over_its_choices():
    def size(patterns):
        return sum(times for _, times in patterns)

    fewest = {7: (75, 77), 100: (1067, 1089)}  # by the first descent, by best fit decreasing
    for times, (descent, best_fit) in fewest.items():
        rng = random.Random(2)
        counts = Counter({rng.randint(150, 500): times * rng.randint(1, 9) for _ in range(8)})
        assert size(packing.best_fit_decreasing(counts, 1024)) == best_fit
        assert size(packing.bin_completion(counts, 1024, nodes=-1)) == best_fit
        found = packing.bin_completion(counts, 1024)
        assert packing.lower_bound(counts, 1024) <= size(found) < descent
        used = Counter()
        for lengths, n in found:
            assert sum(lengths) <= 1024
            used.update({k: n * lengths.count(k) for k in lengths})
        assert used == counts


def test_fillings_are_all_undominated_ones():
    rng = random.Random(4)
    for _ in range(60):
        counts = Counter(rng.randint(2, 12) for _ in range(rng.randint(0, 8)))
        every = {()}
        for n in counts.elements():
            every |= {tuple(sorted((*x, n))) for x in every}
        wanted = {
            x for x in every
            if sum(x) <= 20 and not any(n <= 20 - sum(x) and counts[n] > x.count(n) for n in counts)
        }
        found = [tuple(sorted(x)) for x in packing.fillings(20, counts)]
        assert len(found) == len(set(found)) and set(found) == wanted
        assert [sum(x) for x in found] == sorted(map(sum, found), reverse=True)


def test_decontamination_finds_altered_passages(spark):
    rng = random.Random(6)

    def words(n):
        return [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n)]

    items = {i: words(rng.choice([8, 15, 30, 60])) for i in range(40)}
    docs, expected = [], set()
    for i in range(120):
        text = words(rng.randint(0, 200))
        if i % 2:
            k = rng.randrange(40)
            passage = list(items[k])
            if len(passage) >= 30:  # one changed word in every ten
                for at in range(rng.randint(3, 9), len(passage), 10):
                    passage[at] = "changed"
            at = rng.randint(0, len(text))
            text = [*text[:at], *passage, *text[at:]]
            expected.add((i, k))
        docs.append((i, ", ".join(text).replace("ab", "AB")))
    out = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id bigint, text string"),
    )
    assert {(r.doc_id, r.item_id) for r in out.collect()} == expected


def altered(wrong, size):
    """A document with one item of ``size`` words in it, of which those at ``wrong`` differ:
    whether the item is found."""
    item = [f"i{k}" for k in range(size)]
    passage = [f"x{k}" if k in wrong else w for k, w in enumerate(item)]
    texts = [" ".join(item).encode(), " ".join(["a b c", *passage, "d e f"]).encode()]
    (_, _, (own,), _), = word_hashes(texts[:1], True)
    (_, _, (words,), offsets), = word_hashes(texts[1:], True)
    places = {}
    for n, at, hashes in decontamination.item_seeds(own):
        for place, h in zip(at.tolist(), hashes.tolist()):
            places.setdefault((n, h), []).append(place)
    masks = decontamination.all_masks({n for n, _ in places} - {0})
    lines = {
        (n, at - place)
        for n, _, ats, hashes in decontamination.window_seeds(words, offsets, masks)
        for at, h in zip(ats.tolist(), hashes.tolist())
        for place in places.get((n, h), [])
    }
    for n, shift in lines:
        low, high = max(shift, 0), min(len(words), shift + size)
        if decontamination.judged(words[low:high] == own[low - shift : high - shift], n):
            return True
    return False


def test_decontamination_hits_every_choice_of_changed_words():
    for size in range(13, 21):
        for wrong in combinations(range(1, size - 1), 2):
            assert altered(wrong, size), (size, wrong)
    for wrong in combinations(range(1, 14), 3):
        three = any(k in wrong and k + 1 in wrong and k + 2 in wrong for k in wrong)
        assert altered(wrong, 15) != three, wrong
    for size in (15, 20, 26, 60, 203):
        for first in range(1, 5):
            assert altered(range(first, size - 1, 5), size), (size, first)
    # not an overlap: too few words, or too few that agree
    assert not altered((0, 1), 14) and not altered((2, 6, 10), 14)


def test_decontamination_of_short_items():
    for size in range(1, 13):
        for n in range(size // 5 + 2):
            found = {altered(wrong, size) for wrong in combinations(range(size), n)}
            assert found == {n <= size // 5}, (size, n)


def every_overlap(docs, items):
    """All diagonals of all pairs, without seeds."""
    out = []
    for doc_id, text in docs:
        words = re.findall(r"[0-9a-z]+", (text or "").lower())
        for item_id, own in items:
            own = re.findall(r"[0-9a-z]+", (own or "").lower())
            short = 0 < len(own) < decontamination.LEAST
            for shift in range(-len(own) + 1, len(words)) if own else ():
                low, high = max(shift, 0), min(len(words), shift + len(own))
                if short and (shift < 0 or high - shift < len(own)):
                    continue
                equal = np.array([words[k] == own[k - shift] for k in range(low, high)], dtype=bool)
                for a, b, same in decontamination.judged(equal, len(own) if short else 0):
                    out.append((doc_id, item_id, low + a, low + b, low + a - shift, same))
    return sorted(out, key=str)


def test_decontamination_against_all_diagonals(spark):
    rng = random.Random(16)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(n))) for k, n in enumerate([1, 3, 7, 12, 13, 20, 45, 70])]
    items += [(20, items[5][1]), (21, ""), (22, None), (5, items[5][1])]
    docs = [(None, items[5][1]), (1, None), (2, ""), (3, "?")]
    for i in range(10, 40):
        text = [rng.choice(WORDS) + rng.choice(["", "x"]) for _ in range(rng.choice([5, 40, 150]))]
        passage = noisy(rng, rng.choice(items[:8])[1].split(), rng.choice([0, 0.1, 0.2, 0.3]))
        at = rng.randint(0, len(text))
        docs.append((i, " ".join([*text[:at], *passage, *text[at:]])))
    docs += [docs[10]] * 3 + [(50, docs[10][1])]
    expected = every_overlap(docs, items)
    assert len(expected) > 50
    for block in (1024, 7):  # blocks shorter than items and texts, too
        out = decontamination.overlaps(
            spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3),
            spark.createDataFrame(items, "item_id bigint, text string"),
            block,
        )
        assert sorted(map(tuple, out.collect()), key=str) == expected


def test_word_hashes_do_not_depend_on_the_run():
    texts = [b"Some words here", b"", None, "naïve café".encode(), b"x" * 3_000_000 + b" tail words"]
    alone = [np.concatenate([h for _, _, (h,), _ in word_hashes([t])]) for t in texts]
    for first, _, (hashes,), offsets in word_hashes(texts):
        for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
            assert (hashes[a:b] == alone[first + i]).all() and len(alone[first + i]) == b - a
    assert [len(a) for a in alone] == [3, 0, 0, 2, 3]


def test_line_dedup_against_sql(spark):
    from oracle_compare import connect, differences

    from supplypanel.llm.line_dedup import OP6_SQL, op6_line_dedup

    assert differences(op6_line_dedup(spark, SMALL), connect(SMALL), OP6_SQL) == []


def test_line_dedup_around_the_threshold(spark):
    """Groups of lines with a few changed words, some with a frequent word in common."""
    import duckdb

    from supplypanel.llm import line_dedup

    rng = random.Random(9)
    docs = []
    for i in range(250):
        base = random.Random(i % 12)
        words = [base.choice(WORDS) + base.choice(WORDS) for _ in range(base.choice([3, 5, 8, 14, 30, 90]))]
        lines = [" ".join(noisy(rng, words, rng.choice([0, 0.03, 0.08, 0.15]))) for _ in range(2)]
        docs.append((i, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    expected = {r[0]: r[3] for r in con.execute(line_dedup.OP6_SQL).fetchall()}
    for few in (line_dedup.FEW, 3):
        line_dedup.FEW, before = few, line_dedup.FEW
        decided, _ = line_dedup.decide_lines(df)
        line_dedup.FEW = before
        out = {i: [] for i, _ in docs}
        for r in decided.where("removed").collect():
            out[r.doc_id].append(r.line)
        assert {i: ",".join(map(str, sorted(x))) for i, x in out.items()} == expected


def test_line_dedup_compares_slightly_different_copies_with_the_earliest(spark, monkeypatch):
    """200 lines that differ in one word: pairs grow with the lines, not with their square."""
    import duckdb

    from supplypanel.llm import line_dedup

    common = " ".join(f"shared{i}" for i in range(19))
    # the last ones have only the later copies, not the earliest, as similar ones
    chain = [" ".join(f"chain{i}" for i in range(k, k + 20)) for k in range(0, 8, 2)]
    long = [" ".join(f"long{(i * 7 + k) % 400}" for i in range(100)) for k in range(0, 60, 3)]
    texts = [f"{common} own{i}" for i in range(200)] + chain + long
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    expected = {r[0]: r[3] for r in con.execute(line_dedup.OP6_SQL).fetchall()}
    compared = []
    write = line_dedup.written

    def counted(rows, name):
        out, folder = write(rows, name)
        if name == "pairs":
            compared.append(out.count())
        return out, folder

    monkeypatch.setattr(line_dedup, "written", counted)
    decided, _ = line_dedup.decide_lines(df)
    got = {r[0]: r[1] for r in decided.select("doc_id", "removed").collect()}
    assert got == {k: v != "" for k, v in expected.items()}
    assert sum(compared) < 5 * len(texts)


def test_buckets_of_the_same_rows_are_asked_once(spark):
    from supplypanel.llm.ngram_join import unsettled

    same = [(k, rep, rep) for k in range(40) for rep in (1, 2, 3)]
    other = [(50, 1, 1), (50, 2, 2), (60, 4, 4), (60, 5, 4), (70, 1, 1), (70, 4, 4)]
    members = spark.createDataFrame(same + other, "number bigint, rep bigint, component bigint")
    assert sorted(r[0] for r in unsettled(members).collect()) == [0, 50, 70]


def test_a_pair_of_many_common_buckets_is_raised_once(spark):
    from supplypanel.llm.ngram_join import NAMED_BUCKETS, open_pairs

    # 1 and 2 have all buckets in common, 3 and 4 such as only one of them names
    late = 2 * NAMED_BUCKETS
    members = [(k, rep, rep) for k in range(2 * late) for rep in (1, 2)]
    members += [(1000 + k, 3, 3) for k in range(late + 2)] + [(1000 + late - 2 + k, 4, 4) for k in range(late)]
    members += [(2000, 5, 5), (2000, 6, 5), (2001, 5, 5), (2001, 1, 1)]
    rows = spark.createDataFrame(members, "number bigint, rep bigint, component bigint")
    marks = spark.createDataFrame(
        [(rep, 100, [0] * 8) for rep in range(1, 7)], "rep bigint, n bigint, sketch array<bigint>"
    )
    found = [tuple(r) for r in open_pairs(rows, marks, 85).collect()]
    assert set(found) == {(2, 1), (4, 3), (5, 1)}
    assert found.count((2, 1)) == 1


def test_line_dedup_of_two_texts_of_one_document(spark):
    """A line of the later text goes for one of the earlier text that stands further down and
    goes itself."""
    from supplypanel.llm import line_dedup

    words = [f"word{i}" for i in range(10)]
    first = " ".join(words)
    second = " ".join(["other0", *words[1:]])  # similar to the first
    third = " ".join(["other0", "other1", *words[2:]])  # similar to the second only
    rows = []
    for k in range(40):
        down = "\n".join(f"alone{k}x{i}" for i in range(7)) + f"\n{second}"
        rows.append((k, down, f"{third}\nlast{k}"))
    df = spark.createDataFrame(rows, "k int, down string, up string")
    chosen = df.where("xxhash64(down) < xxhash64(up)").first()
    docs = [(1, first), (5, chosen.down), (5, chosen.up)]
    out = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string"))
    left = sorted((r.doc_id, r.text) for r in out.select("doc_id", "text").collect())
    without_second = chosen.down.rsplit("\n", 1)[0]
    assert left == sorted([(1, first), (5, without_second), (5, chosen.up.split("\n")[1])])


def test_line_dedup_deals_few_numbers_by_key_once(spark, monkeypatch):
    """Both sides of the search read one shuffle."""
    from supplypanel.llm import line_dedup

    text = "\n".join(" ".join(f"w{(i * 7 + k) % 90}" for k in range(12)) for i in range(30))
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string")
    plans, write = [], line_dedup.written

    def seen(rows, name):
        if name == "pairs":
            plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows, name)

    monkeypatch.setattr(line_dedup, "written", seen)
    line_dedup.decide_lines(df)
    assert plans[0].count("RepartitionByExpression [word") == 2


def test_line_dedup_makes_each_bitmap_once(spark, monkeypatch):
    """Searches read the bitmaps that were made before; all prefix words are counted."""
    from supplypanel.llm import line_dedup

    text = "\n".join(" ".join(f"w{(i * 7 + k) % 90}" for k in range(12)) for i in range(30))
    df = spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string")
    plans, write = {}, line_dedup.written

    def seen(rows, name):
        plans.setdefault(name, []).append(rows._jdf.queryExecution().optimizedPlan().toString())
        return write(rows, name)

    monkeypatch.setattr(line_dedup, "written", seen)
    line_dedup.decide_lines(df)
    for name in ("lines", "places", "pairs", "words", "decided"):
        assert not any("collect_list" in plan for plan in plans[name])
    counted = [plan for plan in plans["bitmap"] if "explode(slice(prefix" in plan]
    assert len(counted) == 1 and "seldom" not in counted[0]
