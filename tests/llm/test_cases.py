"""Defined cases of the training-data operators: clashing names, content that must stay, slow versions."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vernal.llm import decontaminate, html, language_id, lm, mixing, secrets, simhash, similar, toxicity
from vernal.llm.common import Hidden

SF = "/root/testdata/sf0.001"


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- columns of the input that are called like an operator's own
CLASH = ["score", "bits", "lang_pred", "letter", "leaks", "more", "size", "key", "taken", "copies", "target", "shard", "rank", "sid", "block", "words", "assign", "markov", "__text", "__gap", "n_tokens", "uid", "rare", "fp", "n_hot", "base_score", "__id", "__h", "node", "Score"]


def clashing(df, names=CLASH):
    return df.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in names if c not in df.columns])


@pytest.fixture(scope="module")
def crowded(spark):
    own = [c for c in CLASH if c != "Score"]
    return clashing(docs(spark).where("doc_id < 60"), own).persist()


def returned(out, names):
    """Rows in which a column of the input, under its own name or name_in, has its own value."""
    for c in names:
        at = c + "_in" if c + "_in" in out.columns else c
        bad = out.where(F.col(f"`{at}`") != F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string"))).count()
        assert at in out.columns and not bad, (c, at)


def test_clashing_columns_come_back(spark, crowded):
    own = [c for c in CLASH if c != "Score"]
    outputs = {
        "identify": language_id.identify(crowded, language_id.fit(docs(spark))),
        "leaks": decontaminate.contaminated(crowded, spark.read.parquet(f"{SF}/benchmark.parquet")),
        "scan": secrets.scan(crowded, [0.0] * 68**2),
        "sized": mixing.sized(crowded),
        "toxicity": toxicity.score(crowded, toxicity.train(["bad word here"] * 4, ["good words there"] * 9, 0.2)),
        "unfitted": toxicity.score(crowded, None),
        "representatives": simhash.representatives(crowded, simhash.near_duplicates(crowded)),
    }
    for name, out in outputs.items():
        assert out.count() > 0, name
        returned(out, own)
    vocabulary = lm.word_counts(crowded)
    scorer, _ = lm.fit(crowded.select("doc_id", "text"), vocabulary)
    returned(lm.score(crowded, scorer, vocabulary), own)
    rows = mixing.sized(crowded)
    slim = rows.select("source", "size", "key")
    mixed = mixing.mix(rows, mixing.plan(slim))
    returned(mixed, [c for c in own if c not in ("size", "key")])
    pages = spark.createDataFrame([(1, "u", "<p>a", "mine", 7)], "page_id long, url string, html string, text string, n_chars long")
    r = html.main_text(pages).first()
    assert (r["text"], r["n_chars"], r["text_in"], r["n_chars_in"]) == ("a", 1, "mine", 7)


def test_pipeline_keeps_clashing_columns(spark, crowded):
    own = [c for c in CLASH if c != "Score"]
    now = crowded.drop("__gap", "__text", "__id", "__h")
    kept = [c for c in own if c in now.columns]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF).persist()
        assert now.columns == crowded.drop("__gap", "__text", "__id", "__h").columns and now.count() > 0
        returned(now, kept)
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()


def test_hidden_names(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, A_in int, `b.c` int, text int")
    h = Hidden(df)
    out = h.shown(h.df.withColumn("a", F.lit(9)), "a")
    assert out.columns == ["a_in_", "A_in", "b.c", "text", "a"] and tuple(out.first()) == (1, 2, 3, 4, 9)
    with pytest.raises(ValueError):
        h.name("none")


# --- HTML: what must stay, brute force, long pages
P = "".join(f"<p>{'A paragraph of the article which is long enough. ' * 4}{i}</p>" for i in range(4))


@pytest.mark.parametrize("kept", ["<ul><li><a href=a>First reference</a></li><li><a href=b>Second reference</a></li></ul>", '<div class="notice-of-motion">The motion was carried.</div>', "<p><a href=x>Only a link</a></p>", "<table><tr><td>cell<td>other</table>", "<p>Short.</p>", "<blockquote>Quoted words</blockquote>"])
def test_html_keeps_what_lies_in_the_article(kept):
    words = " ".join(re.sub("<[^>]*>", " ", kept).split())
    for frame in ("<article>{}</article>", '<div id="page"><nav><a href=m>Menu</a></nav><div>{}</div></div>', '<main class="post">{}</main>'):
        out = html.extract(f"<body>{frame.format(P + kept + P)}<footer>foot</footer></body>")
        assert " ".join(out.split()).count(words) == 1 and "Menu" not in out and "foot" not in out, frame
        assert len(out.split("\n")) >= 9


def test_html_class_words_of_the_main_text():
    out = html.extract(f'<body><div class="post tags-news share">{P}</div><div>{"Some unrelated words beside it. " * 3}</div></body>')
    assert out.count("A paragraph of the article") == 16
    out = html.extract(f'<body><div class="ad-box"><p>{"Buy this now please. " * 30}</p></div><div>{P}</div><div class="cookie-notice">Cookies!</div></body>')
    assert "Buy" not in out and "Cookies" not in out and out.count("A paragraph") == 16


def test_html_density_decides(monkeypatch):
    page = f'<body><div>Words of a banner</div><div><h1>Title</h1>{P}</div><div><a href=a>One</a> <a href=b>Two</a></div></body>'
    want = html.extract(page)
    assert want.startswith("Title\nA paragraph") and "banner" not in want and "One" not in want
    monkeypatch.setattr(html, "_density", lambda *a: 0.0)
    assert html.extract(page) != want


def test_html_densities_against_recursion():
    page = f'<html><body><div>one <b>two</b> <a href=x>three four</a></div><section>{P}<ul><li><a href=y>item</a><li>plain</ul></section><nav>no</nav></body></html>'
    root = html.parse(page)
    html.main_nodes(root)

    def below(n):
        c = t = lc = lt = 0
        for x in n.children:
            if isinstance(x, str):
                c += len(" ".join(x.split()))
            elif not x.kind:
                a = below(x)
                c, t, lc, lt = c + a[0], t + a[1] + 1, lc + a[2], lt + a[3]
        return (c, t, c, lt + 1) if n.name == "a" else (c, t, lc, lt)

    body = next(n for n in walk(root) if n.name == "body")
    cb, _, lcb, _ = below(body)
    seen = 0
    for n in walk(body):
        if n.kind:
            continue
        c, t, lc, lt = below(n)
        if c:
            inner = math.log(c / max(c - max(lc, 1), 1) * max(lc, 1) + lcb / cb * c + math.e)
            want = c / max(t, 1) * math.log(1 + c * max(t, 1) / (max(lc, 1) * max(lt, 1))) / max(math.log(max(inner, math.e)), 1.0)
            assert n.density == pytest.approx(want), n.name
            seen += 1
    assert seen > 10


def walk(n):
    yield n
    for c in n.children:
        if not isinstance(c, str):
            yield from walk(c)


@pytest.mark.parametrize("broken", ["<a ", '<a href="', "<b>", "<b><p>", "<i><p><b></i>", "<div>", "<ul><li>", "<td>", "<", "<!--", "<script ", "<dl><dt></dd>", "<p it's>don't</p>", "&", '<a x="\'', "</b>"])
def test_html_time_grows_with_length(broken):
    took = []
    for n in (10_000, 40_000):
        t = time.process_time()
        html.extract(broken * n)
        took.append(time.process_time() - t)
    assert took[1] < 8 * took[0] + 0.5


# --- decontamination: short items; all documents against all items
def test_short_items(spark):
    d = spark.createDataFrame([(0, "the quick brown fox"), (1, "Zebra!"), (2, "quick. Brown"), (3, "brown quick"), (4, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "zebra"), (2, "Quick brown"), (3, ""), (4, "the quick brown")], "item_id long, text string")
    got = {r["doc_id"]: [(x["item_id"], x["score"], x["end_word"]) for x in r["leaks"]] for r in decontaminate.contaminated(d, b).collect()}
    assert got == {0: [(2, 1.0, 3), (4, 1.0, 3)], 1: [(1, 1.0, 1)], 2: [(2, 1.0, 2)], 3: [], 4: []}


def test_leaks_against_every_pair():
    """Smith-Waterman of whole documents against all items with a common seed, no windows and no bounds."""
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdefghijklmnop") * 2 for _ in range(rng.randint(1, 14)))) for k in range(12)]
    texts = []
    for _ in range(60):
        w = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.6:
            own = rng.choice(items)[1].split()
            own = [x if rng.random() < 0.8 else "zz" for x in own]
            at = rng.randint(0, len(w))
            w[at:at] = own
        texts.append(" ".join(w))

    def best(a, b):
        h, top = [0] * (len(b) + 1), 0
        for x in a:
            last, new = 0, [0]
            for j, y in enumerate(b, 1):
                last = max(0, h[j - 1] + (2 if x == y else -1), h[j] - 1, last - 1)
                new.append(last)
            h, top = new, max(top, *new)
        return top

    block = decontaminate.Items(items)
    got = [{x["item_id"] for x in found} for found in decontaminate.leaks(block, [t.encode() for t in texts])]
    for t, found in zip(texts, got, strict=True):
        w = t.split()
        for k, item in items:
            v = item.split()
            n = min(len(v), 3)
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            shared = any(tuple(w[i : i + n]) in grams for i in range(len(w) - n + 1))
            assert (k in found) == (shared and best(v, w) >= 0.5 * 2 * len(v)), (t, item)


# --- secrets: a slow scorer of the same models
def test_secret_spans_against_a_slow_scorer(spark):
    ratios = secrets.train(secrets.samples(docs(spark)))
    size = len(secrets.ALPHABET) + 1

    def ratio(token):
        total, last = 0.0, 0
        for c in token:
            now = secrets.ALPHABET.find(c) + 1
            total, last = total + ratios[last * size + now], now
        return total

    rng, letters = random.Random(3), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    rows = [(r["doc_id"], r["text"]) for r in docs(spark).where("doc_id < 120").collect()]
    planted = 0
    for i, (k, t) in enumerate(rows):
        if i % 3 == 0 and t:
            w = t.split(" ")
            w.insert(len(w) // 2, "".join(rng.choices(letters, k=rng.randint(12, 40))))
            rows[i], planted = (k, " ".join(w)), planted + 1
    rows += [(1000, "password=abcdef12 x " * 700 + "aB3dE5gH7jK9mN1pQ3sT5vW7 " * 300), (1001, None), (1002, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = [k for k, *_ in secrets.KINDS]
    got = {r["doc_id"]: r for r in secrets.scan(df, ratios).select("doc_id", secrets.listing(*kinds, "markov").alias("s"), F.size("markov").alias("n")).collect()}
    found = 0
    for k, text in rows:
        spans = []
        for rank, (kind, pattern, group, least) in enumerate(secrets.KINDS):
            spans += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
        base = list(spans)
        for m in re.finditer(secrets.TOKEN, text or ""):
            if ratio(m[0]) >= secrets.RATIO and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                spans.append((m.start(), 3, m.end(), "markov"))
        assert got[k]["s"] == ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(spans)), k
        found += got[k]["n"] if k < 1000 else 0
    assert planted * 0.95 <= found <= planted * 1.05


# --- language model: a slow softmax
def test_model_scores_against_a_slow_softmax():
    rng = np.random.default_rng(4)
    counts = np.array([9.0, 5, 3, 2, 2, 1, 1, 4])
    weights = lm.begun(counts)
    texts = [np.append(rng.integers(0, 7, 30), 7) for _ in range(20)]
    lm.trained(weights, texts, counts, 0.05, rng)
    r, q, b, c1, c2 = (x.astype(np.float64) for x in weights.params)
    model = weights.model()
    for one in range(9):
        for two in range(9):
            s = q @ (r[one] @ c1 + r[two] @ c2) + b
            want = (s - np.log(np.exp(s).sum())) / math.log(10)
            got = model.log10(np.arange(8), np.full(8, one), np.full(8, two))
            assert np.allclose(got, want, atol=1e-4)


# --- mixing: shards and blocks that follow the volume
def test_shards_follow_the_volume(spark, monkeypatch):
    assert [mixing.shards_of(n) for n in (0, 1 << 20, 1 << 28, (1 << 28) + 1, 1 << 60)] == [16, 16, 16, 32, 1 << 14]
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 2000)
    rows = mixing.sized(docs(spark))
    tables = mixing.plan(rows.select("source", "size", "key"))
    assert tables["sources"].agg(F.max("bits")).first()[0] > mixing.BITS
    got = mixing.mix(rows, tables).select("source", "target", "size", "taken").collect()
    by = {}
    for x in got:
        assert x["taken"] <= 2 * x["size"]
        by.setdefault((x["source"], x["target"]), []).append(x["taken"])
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= max(2.0, 0.01 * target)


def test_crowded_anchors_are_counted_exactly(spark):
    rng = random.Random(6)
    words = [rng.getrandbits(63) for _ in range(40)] + [12345] * 500
    nodes = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "by_word long, node long").repartition(60)
    want = {}
    for w in words:
        for x in similar.cover().near(np.array([w], dtype=np.uint64))[1]:
            want[int(x)] = want.get(int(x), 0) + 1
    got = {r["anchor"]: r["blocks"] for r in similar._crowded(nodes, 100).collect()}
    assert got == {k: math.ceil(n / 100) for k, n in want.items() if n > 100} and got


def test_workers_keep_nothing_for_other_operators(spark):
    import pyarrow as pa

    from vernal.llm import common

    def held(keep):
        def run(batches):
            from vernal.llm import common

            for _ in batches:
                if keep:
                    common.kept("words", dict)
                yield pa.RecordBatch.from_arrays([pa.array([len(common._KEPT)])], names=["n"])

        return [r["n"] for r in common.arrow_map(spark.range(0, 8, 1, 8), run, "n long", keeps=keep).collect()]

    assert held(True) == [1] * 8 and held(False) == [0] * 8


def test_batches_hold_a_few_megabytes(spark):
    import pyarrow as pa

    from vernal.llm.common import arrow_map

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    d = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    n = [r["n"] for r in arrow_map(d, sizes, "n long").collect()]
    assert sum(n) >= 24 << 20 and max(n) <= 6 << 20


def test_batches_are_bounded_in_bytes(spark):
    import pyarrow as pa

    from vernal.llm.common import arrow_map

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    d = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    n = [r["n"] for r in arrow_map(d, sizes, "n long").collect()]
    assert sum(n) == 60 and max(n) <= 18


# --- language model: words looked up by their bytes, steps that compute a class once
def test_words_are_cut_and_looked_up_as_python_does():
    rng = random.Random(11)
    signs = ["a", "b", "B", "é", "É", "\0", " ", "\t", "\x0b", "\x1c", " ", "\r\n", "xxxxxxxx", "yyyyyyyy"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))).encode() for _ in range(300)] + [b"", b" ", b"a", b"a\0", b"\0a"]
    split = [t.lower().split() for t in texts]
    words = sorted({w for ws in split[::2] for w in ws})
    rng.shuffle(words)
    top = 5
    classes = np.array([i if i < top else top + lm.bucket(w) for i, w in enumerate(words)])
    scorer = lm.Scorer(None, b" ".join(words), classes, np.zeros(len(words)), np.zeros(len(words)), top, 0.0, 0.0, np.zeros(lm.BUCKETS), 1)
    none = lm.Scorer(None, b"", classes[:0], np.zeros(0), np.zeros(0), 0, 0.0, 0.0, np.zeros(lm.BUCKETS), 1)
    place = {w: i for i, w in enumerate(words)}
    for got, known, n in ((scorer.placed(texts), place, top), (none.placed(texts), {}, 0), (scorer.placed([b""]), place, top)):
        ws = split if len(got.ends) > 1 else [[]]
        flat = [w for x in ws for w in x]
        assert [got.word(i) for i in range(len(got.at))] == flat
        assert got.k.tolist() == [known.get(w, -1) for w in flat]
        assert got.c.tolist() == [known[w] if known.get(w, n) < n else n + lm.bucket(w) for w in flat]
        end = n + lm.BUCKETS
        assert got.with_ends(end).tolist() == [c for a, b in zip(got.begin, got.ends, strict=True) for c in [*got.c[a:b].tolist(), end]]


def test_word_counts_of_odd_texts(spark, monkeypatch):
    texts = ["a A b\0 b", None, "", "a\0 \0 é É", "abcdefgh ABCDEFGH\0 abcdefghi abcdefghabcdefgh abcdefghabcdefghi"] * 3
    want = Counter(w for t in texts for w in (t or "").encode().lower().split())
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    for flush in (lm._FLUSH, 1):
        monkeypatch.setattr(lm, "_FLUSH", flush)
        assert {bytes(r["word"]): r["c"] for r in lm.word_counts(df).collect()} == want


def test_steps_of_training_against_one_token_and_one_draw_at_a_time():
    """The gradients by definition: each token's, and each draw's of the noise, repeated ones too."""
    rng = np.random.default_rng(6)
    counts = np.array([9.0, 5, 3, 2, 2, 1, 1, 4])
    texts = [np.append(rng.integers(0, 7, n), 7) for n in (30, 0, 1, 12)]
    weights, slow = lm.begun(counts), lm.begun(counts)
    params, squares = ([x.astype(np.float64) for x in y] for y in (slow.params, slow.squares))
    noise = lm.noise_law(counts)
    draw, again = np.random.default_rng(2), np.random.default_rng(2)
    for _ in range(3):
        lm.trained(weights, texts, counts, 0.05, draw)
        tokens = [(t[i], t[i - 1] if i else 8, t[i - 2] if i > 1 else 8) for t in texts for i in range(len(t))]
        again.permutation(len(tokens))
        z = np.minimum(np.searchsorted(np.cumsum(noise), again.random(lm.NOISE)), 7)
        r, q, b, c1, c2 = params
        grads = [np.zeros_like(p) for p in params]
        for x, one, two in tokens:
            h = r[one] @ c1 + r[two] @ c2
            g_h = np.zeros(lm.DIM)
            for k, label in [(x, 1), *((k, 0) for k in z)]:
                g = (1 / (1 + np.exp(-(q[k] @ h + b[k] - np.log(lm.NOISE * noise[k])))) - label) / len(tokens)
                grads[1][k] += g * h
                grads[2][k] += g
                g_h += g * q[k]
            grads[0][one] += c1 @ g_h
            grads[0][two] += c2 @ g_h
            grads[3] += np.outer(r[one], g_h)
            grads[4] += np.outer(r[two], g_h)
        for p, s, g in zip(params, squares, grads, strict=True):
            s += g * g
            p -= 0.05 * g / np.sqrt(s)
    for got, want in zip(weights.params, params, strict=True):
        assert np.allclose(got, want, atol=2e-4)


def test_looking_up_words_takes_less_than_half_of_a_dict():
    """Before: split() and a dict of Python's strings, most of the time of reading and scoring a text."""
    rng = random.Random(5)
    words = list({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 11))).encode() for _ in range(120_000)})
    text = b" ".join(rng.choices(words, k=400_000))
    n = len(words)
    scorer = lm.Scorer(None, b" ".join(words), np.arange(n) % 1000, np.zeros(n), np.zeros(n), 1000, 0.0, 0.0, np.zeros(lm.BUCKETS), 1)
    place = {w: i for i, w in enumerate(words)}

    def taken(f):
        f()
        times = []
        for _ in range(3):
            t = time.process_time()
            f()
            times.append(time.process_time() - t)
        return min(times)

    assert taken(lambda: scorer.placed([text])) < 0.5 * taken(lambda: [place.get(w) for w in text.lower().split()])
