"""The operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from compare import oracle, rows

from sparsefold.llm import chat_format as chat
from sparsefold.llm import fingerprints, html_extract, mixing, packing, quality_rules, registry, sharding, simhash, token_counts, training, warc
from sparsefold.llm.common import order_keys, range_buckets

WORDS = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY doc_id").fetchall()


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_against_sql(spark, sf_dir, name):
    assert rows(registry.queries()[name](spark, sf_dir)) == oracle(registry.oracles()[name], sf_dir)


# 1


def test_html_held_out():
    model, right = html_extract.trained(), 0
    for source in training.labelled_pages(200, seed=77):
        page = html_extract.parse(source)
        truth = html_extract.known_states(page)
        right += html_extract.extract([source], model)[0] == html_extract.text_of(page, [s if s >= 0 else html_extract.IN for s in truth])
    assert right >= 180


def test_html_pages(spark, sf_dir):
    def plain(page):
        a = page.index("<article>")
        b = page.find("</article>", a)
        inside = re.sub(r"<[^>]*(>|$)", lambda m: " " if re.match(r"</?(p|h1|br)\b", m[0]) else "", page[a : b if b >= 0 else len(page)])
        import html

        return " ".join(html.unescape(inside).split())

    want = {i: plain(h) for i, h in duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_extract.query(spark, sf_dir).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_html_parser():
    page = html_extract.parse('<body><p>a &amp; b<p>c<script>if (x < "</p>") {}</script><ul><li>d<li>e</ul><!-- <p>f -->g<br/>h')
    assert page.tag == ["", "body", "p", "p", "ul", "li", "li"] and [page.parent[i] for i in (3, 5, 6)] == [1, 4, 4]
    assert html_extract.text_of(page, [html_extract.IN] * 7) == "a & b c d e g h"


def test_html_parser_takes_linear_time():
    for page in ("<div>" * 30_000 + "</p>" * 30_000, "<button>" * 30_000, "<div><section>" * 10_000 + "</section>" * 20_000, '<p class="' * 30_000, "<!--" * 30_000, "<head>" * 30_000 + "x", "<svg>" * 9000 + "</svg>" * 8000):
        html_extract.extract([page], html_extract.trained())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<head><title>t</title><p>Text of a page whose head has no end, and goes on for a while.</p>", "Text of a page whose head has no end, and goes on for a while."),
        ("Bare text with &lt;tags&gt; &amp;\n more of it", "Bare text with <tags> & more of it"),
        ('<body><div id="menu"><a>one</a> <a>two</a></div><div id="content"><h2>Title</h2><p>LONG</p></div><div id="sidebar"><p>About me: I write.</p></div><div id="footer">Powered by words</div></body>', "Title LONG"),
        ('<body><div class="cookie-banner"><p>We use cookies to improve your experience here.</p></div><div class="post"><h1>Head</h1><p>LONG</p><div class="ad">Buy now!</div><p>Bye.</p></div><form class="newsletter"><p>Subscribe to our newsletter for more.</p></form></body>', "Head LONG Bye."),
        ('<body><nav><a>x</a></nav><article><h1>Head</h1><p>LONG</p></article><div id="comments"><article class="comment"><p>LONG</p></article></div><footer>f</footer></body>', "Head LONG"),
    ],
)
def test_html_layouts(page, text):
    long = " ".join(["This is a rather long sentence on the matter at hand, which goes on."] * 4)
    assert html_extract.extract([page.replace("LONG", long)], html_extract.trained()) == [text.replace("LONG", long)]


def test_decoding_never_contradicts():
    r = np.random.default_rng(0)
    for _ in range(200):
        n = int(r.integers(1, 9))
        parent = [-1, *[int(r.integers(0, i)) for i in range(1, n)]]
        scores = np.log(r.dirichlet([1, 1, 1], n))
        legal = lambda s: all((s[p] == 2 or (s[p] == 0 and s[i] != 2) or (s[p] == 1 and s[i] == 1)) for i, p in enumerate(parent) if i)  # noqa: B023, E731
        best = max((s for s in itertools.product(range(3), repeat=n) if legal(s)), key=lambda s: sum(scores[i][s[i]] for i in range(n)))  # noqa: B023
        assert tuple(html_extract.decode(parent, scores.copy())) == best


# 2


def test_quality_counts(documents):
    for _, text in [*documents[:60], (0, "a b " * 9), (0, "x y z " + "a b c d e f g h " * 2 + "q"), (0, "a\n\n a \na\r\na")]:
        words, n = re.findall(WORDS, text), len(re.findall(WORDS, text))
        places = collections.defaultdict(list)
        for i in range(n - 7):
            places[tuple(words[i : i + 8])].append(i)
        covered = {j for v in places.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if re.search(WORDS, x)]
        t = quality_rules.Text(text)
        assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_quality_order_and_short_circuit():
    ran = []
    rule = lambda name, out: quality_rules.Rule(name, lambda t: ran.append(name) or out)
    rules = (rule("dear", True), rule("cheap", True), rule("idle", False))
    ordered = quality_rules.order(rules, {"dear": (1.0, 0.5), "cheap": (0.1, 0.5), "idle": (0.01, 0.0)})
    assert [r.name for r in ordered] == ["cheap", "dear", "idle"]
    assert quality_rules.verdict(quality_rules.Text("x"), ordered) == "cheap" and ran == ["cheap"]


def test_cascade_weighs_what_is_left(spark):
    rule = lambda name, needs=("words",): quality_rules.Rule(name, lambda t: False, needs)
    rules = (rule("a"), rule("b"), rule("c", ("lines",)), rule("d", ("words", "numbers")))
    costs, pieces = dict.fromkeys("abcd", 1.0), {"words": 10.0, "numbers": 5.0, "lines": 1.0}
    both = frozenset("ab")
    # b rejects only what a does; c is cheap; d's words are ready once a has run
    sample = quality_rules.Sample(costs, pieces, {both: 30, frozenset("a"): 5, frozenset("c"): 4, frozenset("d"): 3, frozenset(): 58})
    assert [r.name for r in quality_rules.cascade(rules, sample)] == ["a", "c", "d", "b"]
    found = quality_rules.measure(spark.createDataFrame([("x",), ("# # # #",), (None,)], "text string"))
    assert sum(found.rejected.values()) == 3 and found.rejected[frozenset({"few_words", "symbols", "wordless", "stutter"})] == 1
    assert set(found.rules) == {r.name for r in quality_rules.RULES} and set(found.pieces) == set(quality_rules.PIECES)


def test_quality_labels(spark, sf_dir):
    labels = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{sf_dir}/labels.parquet'").fetchall())
    for r in quality_rules.query(spark, sf_dir).collect():
        if r["doc_id"] in labels and not r["base_failed"]:
            assert r["kept"] == bool(labels[r["doc_id"]])


# 3


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = sharding.Feistel(n, 7)
    places = [f.place(r) for r in range(n)]
    assert sorted(places) == list(range(n)) and [f.source_row(p) for p in places] == list(range(n))


def test_feistel_column(spark):
    f = sharding.Feistel(5000, 3)
    got = spark.range(5000).select("id", f.column(__import__("pyspark").sql.functions.col("id")).alias("p")).collect()
    assert all(f.place(r["id"]) == r["p"] for r in got)


def test_shards(spark, sf_dir, documents):
    out = {r["doc_id"]: r for r in sharding.query(spark, sf_dir).collect()}
    f = sharding.Feistel(len(documents), 20240229)
    for row, (i, text) in enumerate(documents):
        data = text.encode()
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["row"]) == (len(data) + 1, zlib.crc32(data), row)
        assert out[i]["slot"] * 8 + out[i]["shard"] == f.place(row)
    again = sharding.feistel_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").repartition(13)).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in again} == {(r["doc_id"], r["shard"], r["slot"]) for r in out.values()}


def test_range_buckets_keep_the_order(spark):
    df = spark.createDataFrame([(random.Random(i).choice([None, 1, 1, 1, i]), str(i % 7)) for i in range(500)], "doc_id long, text string")
    keys = order_keys("doc_id", "text")
    b = range_buckets(df, keys, 20)
    found = df.select(b.bucket(keys).alias("b"), *[k.alias(f"k{j}") for j, k in enumerate(keys)]).collect()
    ordered = sorted(tuple(r[1:]) + (r[0],) for r in found)
    assert [r[-1] for r in ordered] == sorted(r[-1] for r in ordered) and len({r[-1] for r in ordered}) > 5


# 4


def _shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(spark, sf_dir, documents):
    out = {r["doc_id"]: r for r in fingerprints.query(spark, sf_dir).collect()}
    down = documents[::-1]
    errors = []
    for k, (i, text) in enumerate(down):
        after = down[(k + 1) % len(down)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert out[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and out[i]["n_chars"] == len(text)
        a, b = _shingles(text), _shingles(edited)
        errors.append(abs(out[i]["near_edited"] - len(a & b) / max(1, len(a | b))))
    assert sum(errors) / len(errors) < 0.08


def _sketch(text, fraction=0.25):
    """Spark's xxhash64 of several strings is XXH64 of each with the one before as its seed, from 42."""
    found = set()
    for shingle in _shingles(text):
        h = 42
        for w in shingle:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h - (1 << 64) if h >> 63 else h)
    low = sorted(h for h in found if h < -(1 << 63) + int(fraction * (1 << 64)))
    return low, None if low or not found else min(found)


def _digits(sketch):
    low, least = sketch
    return "".join(f"{h & (1 << 64) - 1:016x}" for h in low) if least is None else f"~{least & (1 << 64) - 1:016x}"


def _likeness(a, b):
    (x, p), (y, q) = a, b
    return len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else float(p == q)


def test_every_fingerprint_column(spark, documents):
    texts = [t for _, t in documents[:60]] + ["", "one two", "one two three", "x", "a b c d e f", "a b c d e f", "É é ß x y z"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "doc_id long, text string")
    df.write.mode("overwrite").parquet(f"{spark.conf.get('spark.checkpoint.dir')}/fingers/documents.parquet")
    out = {r["doc_id"]: r for r in fingerprints.query(spark, f"{spark.conf.get('spark.checkpoint.dir')}/fingers").collect()}
    down = [*texts, ""][::-1]
    for k, text in enumerate(down):
        r, after = out[len(texts) - k], down[(k + 1) % len(down)]
        half = len(text) // 2
        own, changed, nxt = _sketch(text), _sketch(text[: len(text) - half] + after[:half]), _sketch(after)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (_digits(own), _digits(changed))
        assert (r["near_edited"], r["near_next"]) == (pytest.approx(_likeness(own, changed)), pytest.approx(_likeness(own, nxt)))
        contained = len(set(own[0]) & set(nxt[0])) / len(own[0]) if own[0] else None if own[1] is not None else float(not nxt[0] and nxt[1] is None)
        assert r["contained_in_next"] == (None if contained is None else pytest.approx(contained))


def test_short_texts_in_long_ones(spark):
    from pyspark.sql import functions as F

    r = random.Random(5)
    rows = []
    for _ in range(200):
        long = [f"w{r.randrange(10**6)}" for _ in range(400)]
        at = r.randrange(390)
        rows.append((" ".join(long[at : at + r.randint(6, 10)]), " ".join(long)))
    df = spark.createDataFrame(rows, "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    found = [x[0] for x in df.select(fingerprints.containment(F.col("a"), F.col("b"))).collect()]
    known = [x for x in found if x is not None]
    assert len(known) > 100 and set(known) == {1.0} and None in found


def test_merged_sketches_are_those_of_the_collection(spark):
    from pyspark.sql import functions as F

    texts = [f"a{i} b{i} c{i} d{i} e{i} f{i}" for i in range(40)] + ["", "x"]
    for some in (texts, texts[:3], ["", ""], ["x"], ["x", "y"]):
        df = spark.createDataFrame([(t,) for t in some], "t string")
        got = df.select(fingerprints.sketch(F.col("t")).alias("s")).agg(fingerprints.merge(F.col("s")).alias("m")).first()["m"]
        each = [_sketch(t) for t in some]
        low = sorted({h for x, _ in each for h in x})
        assert list(got["low"]) == low and got["least"] == (None if low else min((p for _, p in each if p is not None), default=None))


def test_whole_fraction_is_exact(spark):
    from pyspark.sql import functions as F

    texts = [("a b c d e f g", "b c d e f g h"), ("x", "x"), ("", ""), ("a b", "")]
    df = spark.createDataFrame(texts, "a string, b string").select(fingerprints.sketch(F.col("a"), fraction=1 - 2**-40).alias("a"), fingerprints.sketch(F.col("b"), fraction=1 - 2**-40).alias("b"))
    got = [tuple(r) for r in df.select(fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.containment(F.col("a"), F.col("b"))).collect()]
    assert got == [(0.5, 2 / 3), (1.0, 1.0), (1.0, 1.0), (0.0, 0.0)]


def test_containment_of_unequal_texts(spark):
    from pyspark.sql import functions as F

    r = random.Random(2)
    long = [f"w{r.randrange(10**6)}" for _ in range(20_000)]
    short = long[5000:5800] + [f"v{i}" for i in range(800)]
    df = spark.createDataFrame([(" ".join(short), " ".join(long))], "a string, b string")
    got = df.select(fingerprints.containment(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))).first()[0]
    assert abs(got - 0.5) < 0.08


# 5


def _simhash(text):
    words = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text))
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in found:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(found))


def test_fingerprint_matches_the_definition(documents):
    for text in [t for _, t in documents[:80]] + ["", "One", "one two", "A B C", "é É a\x0bb", "a\x1cb c d"]:
        assert simhash.fingerprint(text) == _simhash(text)


def _roots(prints):
    """Brute force: the smallest index reachable over pairs at two bits or fewer."""
    at = list(range(len(prints)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = find(i), find(j)
            at[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_links_and_components(spark):
    r = random.Random(4)
    prints = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(25):  # chains and clusters, among them the sign bit
            prints.add(base)
            base ^= 1 << r.choice((63, 62, 7, 8, 31, 32, 33, 0, 15))
            base ^= (1 << r.randrange(64)) * r.randint(0, 1)
            base ^= (1 << r.randrange(64)) * (r.random() < 0.4)
    prints = sorted(prints, key=lambda p: p - (1 << 64) if p >> 63 else p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "_print long")
    pairs = {tuple(x) for x in simhash.links(df).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    found = dict(tuple(x) for x in simhash.components(simhash.links(df)).collect())
    want = _roots(prints)
    assert [found.get(s, s) for s in signed] == [signed[w] for w in want]


def test_near_dedup(spark, sf_dir, documents):
    roots = _roots([_simhash(t) for _, t in documents])
    got = {r["doc_id"]: r["component_id"] for r in simhash.query(spark, sf_dir).collect()}
    assert got == {i: documents[w][0] for (i, _), w in zip(documents, roots, strict=True)}
    kept = simhash.near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({documents[w][0] for w in roots})


def test_near_dedup_survives_another_order_of_rows(spark, tmp_path):
    seen = tmp_path / "seen"

    def reordered(batches):  # every evaluation after the first has the rows the other way round
        found = [b for b in batches if b.num_rows]
        again = seen.exists()
        seen.touch()
        for b in reversed(found) if again else found:
            yield b.take(list(range(b.num_rows))[:: -1 if again else 1])

    texts = ["one two three four"] * 3 + [f"w{i} x{i} y{i} z{i}" for i in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).mapInArrow(reordered, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.near_dedup(df).collect()) == [0, 3, 4, 5, 6, 7]


def _signed(p):
    return p - (1 << 64) if p >> 63 else p


def _clusters(seed, centres, size, flips):
    r = random.Random(seed)
    found = set()
    for _ in range(centres):
        base = r.getrandbits(64)
        for _ in range(size):
            p = base
            for _ in range(r.randint(0, flips)):
                p ^= 1 << r.randrange(64)
            found.add(p)
    return sorted(found, key=_signed)


def _agreeing(x, y):
    """Per half the positions at which two fingerprints agree."""
    same = [(x ^ y) >> 8 * p & 0xFF == 0 for p in range(8)]
    return sum(same[:4]), sum(same[4:])


def test_candidates_have_their_tally(spark):
    prints = _clusters(8, 40, 4, 9)
    df = spark.createDataFrame([(_signed(p),) for p in prints], "_print long")
    found, dense = simhash.candidates(df)
    want = {}
    for x, y in itertools.combinations(prints, 2):
        met = sum(n for n in _agreeing(x, y) if n >= 3)
        if met >= 4:
            want[_signed(x), _signed(y)] = met
    met_once = sum(sorted(_agreeing(x, y))[1] == 3 > sorted(_agreeing(x, y))[0] for x, y in itertools.combinations(prints, 2))
    assert dense is None and met_once > 10 and {(r["a"], r["b"]): r["shared"] for r in found.collect()} == want


@pytest.mark.parametrize(("long_list", "flips"), [(16, 3), (2, 3), (16, 6)])
def test_links_in_dense_clusters(spark, long_list, flips):
    prints = _clusters(9, 2, 250, flips)
    df = spark.createDataFrame([(_signed(p),) for p in prints], "_print long")
    got = sorted(tuple(r) for r in simhash.links(df, long_list=long_list).collect())
    assert got == sorted((_signed(x), _signed(y)) for x, y in itertools.combinations(prints, 2) if (x ^ y).bit_count() <= 2)


def _five(text):
    words = re.findall(WORDS, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def _similar_roots(texts, similarity=0.8):
    """Brute force: the smallest index reachable over pairs of that Jaccard likeness."""
    sets, at = [_five(t) for t in texts], list(range(len(texts)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        x, y = sets[i], sets[j]
        if len(x & y) >= similarity * len(x | y):
            a, b = find(i), find(j)
            at[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_near_dedup_by_likeness(spark, documents, monkeypatch):
    from sparsefold.llm import similar

    r = random.Random(12)
    texts = [t for _, t in documents] + ["", " ", "a b", "A  b"]
    for _, t in documents[:40]:  # near copies on both sides of the likeness, in chains
        for _ in range(4):
            words = t.split()
            for _ in range(r.randint(0, max(1, len(words) // 30))):
                words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
            t = " ".join(words)
            texts.append(t)
    want = sorted(set(_similar_roots(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(texts) - len(want) > 60
    assert sorted(x["doc_id"] for x in simhash.near_dedup(df, similarity=0.8).collect()) == want
    monkeypatch.setattr(similar, "BLOCK_SHINGLES", 300)  # blocks against blocks
    assert sorted(x["doc_id"] for x in simhash.near_dedup(df, similarity=0.8).collect()) == want


def test_postings_are_shared_by_likeness():
    from sparsefold.llm import similar

    r, hit = np.random.default_rng(1), 0
    for _ in range(400):  # at a likeness of 0.8 one of the bands is shared with probability 0.9996
        whole = r.integers(0, 1 << 63, 450, dtype=np.uint64)
        hit += bool(set(similar.postings(whole[:405])) & set(similar.postings(whole[45:])))
    assert hit >= 398


def _behind_a_shuffle(spark, df):
    """df behind an exchange whose partitions Spark merges as it likes, with a wide column that some plans prune."""
    from pyspark.sql import functions as F

    return df.withColumn("wide", F.repeat(F.lit("x"), 3000)).repartition(7, df.columns[0])


@pytest.fixture
def small_partitions(spark):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    yield
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


@pytest.mark.parametrize("similarity", [None, 0.8])
def test_near_dedup_behind_a_shuffle(spark, sf_dir, small_partitions, similarity):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(r["doc_id"] for r in simhash.near_dedup(docs, similarity=similarity).collect())
    assert sorted(r["doc_id"] for r in simhash.near_dedup(_behind_a_shuffle(spark, docs), similarity=similarity).collect()) == want


def test_archives_behind_a_shuffle(spark, tmp_path, small_partitions):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 100}</p>" * 40) for i in range(200)], "page_id long, url string, html string")
    warc.write_archives(_behind_a_shuffle(spark, pages), str(tmp_path / "w"))
    out = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert {(r["page_id"], r["refers_to"]) for r in out if r["record_type"] == "revisit"} == {(i, i - 100) for i in range(100, 200)}
    assert {r["page_id"] for r in out if r["record_type"] == "response"} == set(range(100))


def test_roles_behind_a_shuffle(spark, small_partitions):
    r = random.Random(6)
    data = [(c, 0, r.choice(["user", "assistant", "x"]), "same") for c in range(30) for _ in range(9)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    results = [sorted(tuple(x) for x in chat.repair(d).collect()) for d in (df, _behind_a_shuffle(spark, df))]
    assert results[0] == results[1] and len(results[0]) == 270


def test_scratch_needs_a_shared_folder():
    from sparsefold.llm import common

    class Fake:
        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(Fake)
    assert [common.is_local(m) for m in ("local", "local[8]", "local[*,2]", "local-cluster[2,1,1024]", "yarn", "k8s://x")] == [True, True, True, False, False, False]


def test_scratch_is_cleared(spark):
    from pathlib import Path

    from sparsefold.llm import common

    a, b = (common.stash(spark.range(3), n) for n in ("a", "b"))
    places = [Path(x.inputFiles()[0].removeprefix("file:")).parent for x in (a, b)]
    common.drop_stash(a)
    assert [p.exists() for p in places] == [False, True]
    common.clear_scratch(spark)
    assert not places[1].exists()


# 6


def test_encoder_matches_the_library():
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    r = random.Random(1)
    parts = ["a", "the", "The", "J", "\u030c", "*", "...", "Don't", "ﬁ", "Σ", "ς", "²", "½", "µ", "<|STARTOFTEXT|>", "7", "ß", "\xad", " ", "  ", "\n", "\t", "É", "<|startoftext|>", "é", "漢", "　", "\xa0", "\x00", "'s", "'RE", "́", "</w>", "1", ".", "\x85", "\x1c", "İ", "<|endoftext|>"]
    for _ in range(20_000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert np.frombuffer(e.encode(s), "<u2").tolist() == e.library.encode(s, add_special_tokens=False).ids


def test_encoder_cuts_long_texts(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "CHUNK", 20)
    e = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    r = random.Random(5)
    for _ in range(200):
        texts = [" ".join(f"{r.choice(['the', 'of', 'Run', 'x9,', 'été', '漢字', '<|endoftext|>', '½'])} w{r.randrange(400)}." for _ in range(r.randrange(12))) for _ in range(3)]
        want = [np.array(e.library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
        assert e.encode_all([t.encode() for t in texts]) == want


def test_merges_of_both_libraries(documents):
    import public_tokenizers

    e = packing.Encoder(public_tokenizers.path(packing.TOKENIZER))
    words = {w for _, t in documents for w in packing.PRE_TOKEN.findall((t or "").lower())}
    r = random.Random(3)
    words |= {"".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(1, 14))) for _ in range(20_000)}
    words = sorted(w for w in words if w.isalpha())
    library = e.library.encode_batch(words, add_special_tokens=False)
    assert all(e.merges.encode_ordinary(w + packing.END_MARK) == x.ids for w, x in zip(words, library, strict=True))


@pytest.mark.parametrize("window,shard", [(4096, 2000), (64, 50), (7, 3)])
def test_pack_is_a_partition(spark, sf_dir, documents, window, shard):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    some = documents[:: 1 if window > 100 else 10]
    df = spark.createDataFrame(some, "doc_id long, text string")
    out = packing.pack(df, window=window, shard_pieces=shard).collect()
    whole = {i: np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4") for i, t in some}
    at = dict.fromkeys(whole, 0)
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        ids = whole[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(ids) and r["length"] > 0
        at[r["doc_id"]] += r["length"]
        assert zlib.crc32(ids[r["start"] : at[r["doc_id"]]].tobytes()) == r["ids_crc32"]
    assert all(at[i] == len(ids) for i, ids in whole.items())
    sequences = collections.defaultdict(int)
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences[r["sequence_id"]]
        sequences[r["sequence_id"]] += r["length"]
    assert max(sequences.values()) <= window
    assert sum(v < window for v in sequences.values()) <= max(1, -(-len(out) // max(1, shard // 8)))


def test_neighbours_are_lexical():
    ids = [np.array(x) for x in ([5, 6, 7], [8, 9, 10], [5, 6, 11], [8, 12, 13])]
    index = packing.Index.build(np.full(4, 3), [np.unique(x, return_counts=True) for x in ids], np.ones(20), 3.0)
    assert index.neighbours(0, np.array([False, True, True, True]))[0] == 2
    assert index.neighbours(1, np.array([True, False, True, True]))[0] == 3


def _rests(seed, n, size=(20, 200)):
    r = np.random.default_rng(seed)
    topics = [r.choice(500, 80, replace=False) for _ in range(6)]
    return [r.choice(topics[i % 6], r.integers(*size)) for i in range(n)]


def test_bm25_scores_and_greedy_order():
    rests = _rests(2, 60)
    n, mean = len(rests), np.mean([len(x) for x in rests])
    idf = np.zeros(1 << 16)
    for t in range(500):
        df = sum(t in set(x.tolist()) for x in rests)
        idf[t] = max(0.0, np.log((n - df + 0.5) / (df + 0.5)))

    def score(seed, other):
        total = 0.0
        for t in sorted(set(rests[seed].tolist())):
            tf = int((rests[other] == t).sum())
            total += idf[t] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(rests[other]) / mean))
        return total

    sizes = np.array([len(x) for x in rests])
    index = packing.Index.build(sizes, [np.unique(x, return_counts=True) for x in rests], idf, mean)
    unused, window = set(range(n)), 300
    want, rest = [], None
    while unused or rest:  # the whole greedy walk, by brute force
        if rest is None:
            seed = min(unused, key=lambda i: (-sizes[i], i))
            rest = (seed, 0)
        seed, done = rest
        unused.discard(seed)
        filled, rest = [(seed, done, int(sizes[seed]) - done)], None
        room = window - filled[0][2]
        for other in sorted(unused, key=lambda i: (-round(score(seed, i), 9), i)):
            if not room:
                break
            take = min(room, int(sizes[other]))
            filled.append((other, 0, take))
            unused.discard(other)
            room -= take
            if take < sizes[other]:
                rest = (other, take)
        want.append(filled)
    got = collections.defaultdict(list)
    for sequence, piece, at, length, _ in packing.fill(sizes, index, window):
        got[sequence].append((piece, at, length))
    assert [got[i] for i in range(len(got))] == want


def test_dealing_by_content_keeps_neighbours_together():
    rests = _rests(3, 1200)
    order = sorted(range(len(rests)), key=lambda i: packing.signature(np.unique(rests[i])))
    runs = [order[i : i + 100] for i in range(0, len(order), 100)]
    same = np.mean([[i % 6 == j % 6 for i in run for j in run] for run in runs])
    assert same > 0.4  # one in six by chance


def test_equal_signatures_do_not_grow_a_shard(spark):
    df = spark.createDataFrame([(i, "one two three four") for i in range(900)], "doc_id long, text string")
    out = packing.pack(df, window=64, shard_pieces=20).collect()
    shards = collections.Counter(r["sequence_id"] >> 16 for r in out if r["start"] == 0)
    assert sum(shards.values()) >= 900 and max(shards.values()) <= 20


# 7


def test_mixing(spark, sf_dir):
    docs = duckdb.sql(f"SELECT doc_id, source, text FROM '{sf_dir}/documents.parquet'").fetchall()
    size = {i: len(re.findall(WORDS, t)) + 1 for i, _, t in docs}
    tokens = collections.Counter()
    for i, s, _ in docs:
        tokens[s] += size[i]
    low, high = min(tokens.values()), max(tokens.values())
    exponent = 1 - np.log(1.5) / np.log(high / low)
    weights = {s: t**exponent for s, t in tokens.items()}
    norm = sum(weights.values())
    budget = max(t * norm / weights[s] for s, t in tokens.items())
    out = mixing.query(spark, sf_dir).collect()
    copies = collections.Counter(r["doc_id"] for r in out)
    assert set(copies) == set(size) and max(copies.values()) <= 2
    for s in tokens:
        got, quota = sum(r["n_tokens"] for r in out if r["source"] == s), weights[s] / norm * budget
        assert quota - max(v for i, v in size.items()) <= got <= quota + 1e-3 * quota
    blocks = collections.defaultdict(list)
    for r in out:
        blocks[r["block"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in blocks.values())


def test_exponent_meets_the_entropy(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens long")
    for target in (0.5, 0.8, 1.05):
        a, entropy, _ = mixing.solve(totals, target, None, 1000.0)
        assert abs(entropy - target) < 1e-6 and 0 < a < 1
    assert mixing.solve(totals, None, None, 1000.0)[0] == 0.0


def test_small_budget_takes_part_of_a_pass(spark):
    df = spark.createDataFrame([(i, "w " * 9, "a" if i % 3 else "b") for i in range(600)], "doc_id long, text string, source string")
    out = mixing.schedule(df, budget=3000.0, repetition_limit=None, block_tokens=300).collect()
    by_source = collections.Counter()
    for r in out:
        by_source[r["source"]] += r["n_tokens"]
    assert by_source == {"a": 1500, "b": 1500} and max(collections.Counter(r["id"] for r in out).values()) == 1


# 8


def test_token_counts_match_the_library(documents):
    import public_tokenizers

    proof = token_counts.prove(public_tokenizers.path(token_counts.MODEL))
    assert len(proof.whole) > 10_000
    counter = token_counts.Counter(proof)
    r = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r", "▁", "<s>", "é", "漢", "　", "\xa0", "\x00", " \n", "\n ", "</s>", "1", ".", "<0x0A>", "🙂", "\n\n"]
    for s in [t for _, t in documents] + ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000)]:
        assert counter.count(s) == len(counter.lib.encode(s))


# 9


#: The legal conversations and the costs of repairs, written anew: the operator's own tables are not asked.
FOLLOWS = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}
OTHER_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}


def _repairs(turns):
    """(cost, messages) of every repair of some turns: each opens a message, after an empty one or not, or joins the last."""
    out = [(0, ())]
    for role, text in turns:
        name = (role or "").strip().lower()
        name = OTHER_NAMES.get(name, name)
        new = []
        for cost, messages in out:
            last = messages[-1][0] if messages else None
            for to in ("system", "user", "assistant"):
                named = 0 if name == to else 3 if name in FOLLOWS else 1
                if to in FOLLOWS[last]:
                    new.append((cost + named, (*messages, (to, (text,)))))
                new += [(cost + named + 2, (*messages, (empty, ()), (to, (text,)))) for empty in FOLLOWS[last] if to in FOLLOWS[empty]]
                if to == last:
                    new.append((cost + named + 1, (*messages[:-1], (last, (*messages[-1][1], text)))))
        out = new
    return [x for x in out if x[1] and x[1][-1][0] != "system"]


def _conversation(messages):
    body = lambda texts: "\n\n".join((t or "").replace("<|", "< |") for t in texts)
    return "".join(f"<|im_start|>{role}\n{body(texts)}<|im_end|>\n" for role, texts in messages)


def test_repairs_against_all_others(spark):
    r = random.Random(8)
    names = ["system", "user", "assistant", "Human", " GPT ", None, "tool", "developer"]
    data = [(c, t, r.choice(names), r.choice([f"t{t}", "", None, "<|im_end|>"])) for c in range(120) for t in range(r.randint(1, 5))]
    found = collections.defaultdict(list)
    for row in chat.repair(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).collect():
        found[row["conv_id"]].append(row)
    for c, rows in found.items():
        rows.sort(key=lambda x: x["seq"])
        every = _repairs([(role, text) for i, _, role, text in data if i == c])
        least = min(cost for cost, _ in every)
        assert sum(x["cost"] for x in rows) == least
        assert "".join(x["rendered"] for x in rows) in {_conversation(m) for cost, m in every if cost == least}


def test_roles_are_repaired_cheapest(spark):
    r = random.Random(3)
    names = ["system", "user", "assistant", "Human", None, "x"]
    data = [(c, t, r.choice(names), f"t{t}") for c in range(40) for t in range(r.randint(1, 6))] + [(99, t, r.choice(names), f"t{t}") for t in range(200)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    cut, whole = ({}, {})
    for out, buckets, chunk in ((cut, 40, 3), (whole, 100_000, 100_000)):
        for row in chat.repair(df, rows_per_bucket=buckets, chunk_turns=chunk).collect():
            out.setdefault(row["conv_id"], []).append(row)
    for c in whole:
        mine, other = (sorted(o[c], key=lambda x: x["seq"]) for o in (cut, whole))
        assert [x["seq"] for x in mine] == list(range(len(mine)))
        cost = sum(x["cost"] for x in mine)
        assert cost == sum(x["cost"] for x in other)
        if c != 99:
            assert cost == min(n for n, _ in _repairs([(x["role"], "") for x in mine]))
        state = chat.START
        text = "".join(x["rendered"] for x in mine)
        opened = re.findall(r"<\|im_start\|>(\w+)\n", text)
        for role in opened:
            assert chat.ROLES.index(role) in chat.NEXT[state]
            state = chat.ROLES.index(role)
        assert state in chat.ENDS and text.count("<|im_end|>") == len(opened)


# 10


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_warc_round_trip(spark, tmp_path, chunk):
    risk = "\r\n\r\nWARC/1.0\r\n"
    data = [(1, "u", "x" * 300), (2, "u", "x" * 300), (3, None, None), (None, "u", "x" * 300), (5, "u\r\n5", "WARC/1.0\r\nhi" + risk * 2 + "é" * 60), (6, "u", "tail\r\n"), (7, "u", "t\r\n\r\n"), (8, "u", "é漢🙂" * 90), (9, "u", "ab"), (10, "u", "ab"), (11, "u", risk[:-2]), (12, "u", "\r\n" * 99), (13, "u", "WA")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3), path, chunk_bytes=chunk)
    out = warc.read_archives(spark, path).collect()
    want = sorted((str(i), len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in data)
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in out) == want
    assert {(r["page_id"], r["refers_to"]) for r in out if r["record_type"] == "revisit"} == {(2, 1), (None, 1)}


def test_warc_notices_a_changed_chunk(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(1, "u", "abcdefgh")], "page_id long, url string, html string"), path, chunk_bytes=3)
    chunks = warc.read_chunks(spark, path)
    assert chunks.count() == 3
    for wrong in (chunks.filter("chunk <> 1"), chunks.filter("chunk <> 2"), chunks.withColumn("data", F.when(F.col("chunk") == 1, F.lit(b"xyz")).otherwise(F.col("data")))):
        with pytest.raises(Exception, match="chunk"):
            warc.fold(wrong).collect()


# pipeline


def test_pipeline_stages(spark, sf_dir, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    texts = dict(documents)
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    good = sorted(i for i, t in documents if quality_rules.verdict(quality_rules.Text(t), quality_rules.RULES) is None)
    assert sorted(r["doc_id"] for r in kept.collect()) == good and kept.columns == columns
    roots = _similar_roots([texts[i] for i in good])
    one = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    left = sorted({good[w] for w in roots})
    assert sorted(r["doc_id"] for r in one.collect()) == left and one.columns == columns
    mixed = corpus_pipeline.mixture(spark, one, sf_dir)
    assert {r["doc_id"] for r in mixed.collect()} == set(left) and mixed.columns == columns
    tokens = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"] / r["doc_tokens"]
    copies = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert {i: round(v, 6) for i, v in tokens.items()} == dict(copies)
