"""Tokens, pieces, pages, toxicity."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from balanza.llm import html as pages
from balanza.llm.pieces import Pieces, decoded, encoded
from balanza.llm.pieces import model as pieces_model
from balanza.llm.tokens import TokenCounter, token_counts
from balanza.llm.toxicity import CODES, Channel, Training, fit, toxicity, without_toxic
from tests.conftest import DATOS

ODD = ["", None, " ", "  a  b ", "a\n\nb", "\r\n\t x", "it's WE'LL don't", "<|endoftext|> a <|endoftext|>", "é ß 日本語 \U0001f600", "x" * 3000, "1234567 89", "▁ a▁b", "</s><0x41>", " \x85\x1c!", "a" + " " * 40]


def noise(n):
    rng = random.Random(n)
    parts = [" ", "  ", "\n", "the", "'s", " Thing", "ing", "é", "日", "\U0001f600", "0", "12", "!", "...", "\t", "\x00", chr(0x2028), " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(n)]


def test_token_counts_equal_the_library(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ODD + noise(300)
    rows = {r["doc_id"]: r for r in token_counts(docs(list(enumerate(texts))), path).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert tuple(rows[i]) == (i, len((t or "").encode()), n, n > 512)
    assert token_counts(docs([]), path).collect() == []
    c = TokenCounter(path, most=4000)
    assert [c.count(t or "") for t in texts] == [rows[i]["n_tokens"] for i in range(len(texts))]


def test_pieces_equal_the_library_and_decode_again(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + noise(300)
    out = encoded(docs(list(enumerate(texts)) + [(None, "a"), (0, "")]), path)
    back = {r["doc_id"]: r["text"] for r in decoded(out, path).collect()}
    for r in out.collect():
        t = "a" if r["doc_id"] is None else texts[r["doc_id"]] or ""
        assert r["ids"] == library.encode(t) and r["n_tokens"] == len(r["ids"])
        assert r["lossless"] == ("▁" not in t) and back[r["doc_id"]] == t.replace("▁", " ")
    assert encoded(docs([]), path).collect() == []


def test_pieces_reuse_prefixes_in_any_batch():
    m = pieces_model(public_tokenizers.path("piece_bpe_32k.model"))
    words = ["▁there", "▁therefore", "▁the", "▁x", "there", "▁" * 5 + "a", "\n"]
    together = dict(m.encode_words(words))
    assert together == {w: dict(m.encode_words([w]))[w] for w in words}


def test_pieces_try_only_what_ends_there_and_keep_words_met_again():
    m = Pieces(public_tokenizers.path("piece_bpe_32k.model"), most=20_000)
    assert [p[0] for p in m.states[""]["t"]["h"]["e"].ends] == sorted([k for k in (2, 3) if "the"[-k:] in m.whole], reverse=True)
    assert m.states[""]["\x00"] is m.states[""]
    often = [f"often{i}" for i in range(20)]
    for k in range(40):
        m.encode([" ".join(often + [f"w{k}x{i}" for i in range(10)] + ["y" * 500])])
        assert m.held <= m.most and len(m.known) < m.most // 200
    assert all("▁" + w in m.known for w in often) and not any(len(w) > 64 for w in m.known)
    # The steps between states have a bound of their own.
    m.encode([" ".join(chr(c) + chr(c + 1) for c in range(0x100, 0x300))])
    assert 0 < m.steps <= m.most_steps and sum(map(len, m.states.values())) <= m.most_steps


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>Menu</a></nav>%s<footer>&copy; us</footer></body></html>"


def test_blocks_of_broken_markup():
    got = pages.blocks("<p>a &amp; b&nbsp;c<b>d<br>e<p>f<ul><li>g<li>h</ul>i<script>if (a</p>b)</script>&am<!-- x --><div cla")
    assert [b.text for b in got] == ["a & b cd e", "f", "g", "h", "i&am"]
    assert pages.blocks("") == [] and pages.blocks("<p>  </p>") == []
    # A head without its end tag ends where the body, another element or text begins.
    head = "<html><head><meta charset=utf-8><title>t</title><style>p{}</style><link rel=x>\n"
    for rest in ("<body><article><h1>a</h1><p>b</p></article>", "<article><h1>a</h1><p>b", "</head><body><article><h1>a</h1><p>b</article>"):
        got = pages.blocks(head + rest)
        assert [b.text for b in got] == ["a", "b"] and not any("head" in b.path for b in got)
    assert [b.text for b in pages.blocks(head + "a<p>b")] == ["a", "b"] and [b.text for b in pages.blocks("<p>a<head>b<p>c")] == ["a", "b", "c"]


def test_formulas_and_fallback_text_are_blocks():
    got = pages.blocks(
        "<head><noscript><style>p{}</style></noscript><body><p>area <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup></math> of it"
        "<p><object data=x>a <b>map</b></object><canvas>drawn<p>below</canvas><noscript>plain</noscript><p>open <math><mi>b</mi><p>last"
    )
    assert [b.text for b in got] == ["area a=r2 of it", "a map drawn", "below plain", "open b", "last"]


def test_labeller_on_held_out_varied_pages(spark):
    rows = [r[0] for r in spark.read.parquet(f"{DATOS}/pages.parquet").select("html").collect()]
    net = pages.trained(rows[:100])
    rng = np.random.default_rng(1)
    held = [[(b, pages.rule(b)) for b in pages.blocks(h)] for h in rows[100:160]]
    pool = [b.text for p in held for b, _ in p]
    cases = held + [pages.varied(p, pool, rng) for p in held]
    labels = net.label([[b for b, _ in p] for p in cases])
    wrong = sum(bool(y) != t for p, ys in zip(cases, labels) for (_, t), y in zip(p, ys))
    assert wrong <= 0.02 * sum(map(len, cases))


DIV_PAGE = """<html><body><div class="site-header"><a href=/>Home</a> <a href=/n>News</a></div><div class="%s"><h1>The harbour of %s</h1>
<p>The harbour was built in the year %s, when the old quay could no longer hold the ships that came in from the north.</p><h2>Trade</h2>
<ul><li>salt</li><li>dried fish</li></ul><table><tr><td>Ships</td><td>%s</td></tr></table><p>It is still open.</p></div>
<div class="sidebar"><a href=/a>More of the same kind of page for you</a></div><div class="footer">All rights reserved</div></body></html>"""


def test_articles_in_plain_containers_are_kept_whole(spark):
    places = ["Varde", "Holm", "Lund", "Tarm", "Skive", "Ribe", "Hobro", "Nakskov"]
    rows, want = [], {}
    for i, place in enumerate(places):
        rows.append((i, "u", DIV_PAGE % (("content", "entry-content", "post", "story")[i % 4], place, 1700 + i, 40 + i)))
        want[i] = "\n".join([
            f"The harbour of {place}",
            f"The harbour was built in the year {1700 + i}, when the old quay could no longer hold the ships that came in from the north.",
            "Trade", "salt", "dried fish", "Ships", str(40 + i), "It is still open.",
        ])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in pages.main_text(df).collect()} == want


def test_gradients_follow_differences():
    rng = np.random.default_rng(2)
    net = pages.Labeller(width=5, hidden=3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    x, y = rng.normal(size=(4, 2, 5)), rng.integers(0, 2, (4, 2)).astype(float)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)

    def loss():
        p, _ = net.scores(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for k, w in net.weights.items():
        at = tuple(0 for _ in w.shape)
        keep, e = w[at], 1e-4
        w[at] = keep + e
        up = loss()
        w[at] = keep - e
        down = loss()
        w[at] = keep
        assert grads[k][at] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_pages_with_nulls_and_clashing_columns(spark):
    text = "A long sentence of the article, with enough words to be read as one. " * 3
    html = PAGE % f"<article><h1>Head</h1><p>{text}</p></article>"
    rows = [(1, "u", html, "x", 0), (None, None, html, "x", 0), (2, "u", None, "x", 0), (3, "u", "", "x", 0), (4, "u", "<nav>only</nav>", "x", 0), (1, "u", html, "x", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in pages.main_text(df).collect()), key=repr)
    full = "Head\n" + text.strip()
    assert got == sorted([(1, full, len(full)), (1, full, len(full)), (None, full, len(full)), (2, "", 0), (3, "", 0), (4, "", 0)], key=repr)
    assert pages.main_text(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def toxic(docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        w = [word() for _ in range(40)]
        bad = i % 4 == 0
        if bad:
            w[5], w[20] = rng.choice(["moron", "idiot", "scum"]), rng.choice(["pathetic", "stupid"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_obfuscated_words_are_restored(toxic):
    text = " ".join(t for _, t in toxic[0]) * 3
    from balanza.llm.toxicity import codes

    x = codes(" " + text.replace(" ", "  ")).astype(int)
    counts = np.bincount((x[:-2] * CODES + x[1:-1]) * CODES + x[2:], minlength=CODES**3)
    c = Channel(counts)
    cases = {"1d10t": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "moooooron": "moron", "s-c-u-m": "scum", "p@th3t1c": "pathetic", "$tup1d": "stupid"}
    assert {k: c.restore(k) for k in cases} == cases


def test_toxicity_on_held_out_and_obfuscated_texts(spark, docs, toxic):
    rows, labels = toxic
    hard = [(2000, "then m0r0n and p4thetic there"), (2001, "her i d i o t on re stuuuupid an"), (2002, "m0re than on 1st there"), (2003, None), (2004, ""), (None, "idiot stupid"), (2001, "her i d i o t on re stuuuupid an"), (2005, "an " * 50_000)]
    frame = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(docs(rows + hard), frame, Training(rows=400)).collect()
    assert len(got) == len(rows) + len(hard)
    truth = {i: t for i, _, t in labels}
    import zlib

    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] in truth:
            assert r["predicted"] == truth[r["doc_id"]]
    special = {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] not in truth}
    assert special == {2000: 1, 2001: 1, 2002: 0, 2003: 0, 2004: 0, None: 1, 2005: 0}
    d = docs(rows + hard)
    clean = without_toxic(d, frame)
    assert clean.columns == d.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, t in truth.items() if not t} | {2002, 2003, 2004, 2005}


def counted(texts):
    from balanza.llm.toxicity import codes

    x = codes(" " + "  ".join(texts)).astype(int)
    return np.bincount((x[:-2] * CODES + x[1:-1]) * CODES + x[2:], minlength=CODES**3)


def test_long_and_joined_spaced_runs_are_read_whole(spark, docs, toxic):
    rows, labels = toxic
    plain = [(i, t + " a") for i, t in rows]
    words = "there on the redone in here then an inner on there".split()
    long = " ".join("".join([*words, "stupid"]))
    assert len(long) > 64
    c = Channel(counted([t for _, t in plain]))
    assert {"a", "moron"} <= c.words("a m o r o n")
    assert "stupid" in c.words(long) and c.restore(long) == "".join([*words, "stupid"])
    assert "stupid" in c.words(long.replace(" ", ".")) and "scum" in c.words("p4thet1c-scum")
    # Carried states: a span of any length is one search.
    far = "st" + "4" + "n-" * 40 + "m0r0n"
    assert c.restore(far).endswith("moron") and c.restore("m0ron" * 400) == "moron" * 400
    hard = [(3000, long), (3001, "on a m o r o n an a s t u p i d"), (3002, long.replace(" ", ".")), (3003, " ".join("".join(words)))]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity(docs(plain + hard), frame, Training(rows=400)).collect() if r["doc_id"] >= 3000}
    assert got == {3000: 1, 3001: 1, 3002: 1, 3003: 0}


def test_labels_of_one_kind_and_empty_tables(spark, docs):
    frame = spark.createDataFrame([(i, 0) for i in range(20)], "doc_id long, toxic int")
    got = toxicity(docs([(i, f"text {i}") for i in range(20)]), frame).collect()
    assert {r["predicted"] for r in got} == {0}
    assert toxicity(docs([]), frame).collect() == []
    assert fit(docs([]), frame.limit(0)).features == {}
