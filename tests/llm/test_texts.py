"""Text operators against brute force, planted cases and held-out accuracy."""

import hashlib
import random
import time
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import decontam as dc
from tessera.llm import pii
from tessera.llm import rendering as rd
from tessera.llm import toxicity as tox
from tessera.llm.common import NO_LETTER, Words, chunks

# ---------------------------------------------------------------- personal data

_BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _base(text):
    out = []
    for kind, pattern in _BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            odd, even = digits[-1::-2], digits[-2::-2]
            fine = {
                "email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0, "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda x: (x[0], list(_BASE).index(x[2])))


def test_base_spans_agree_with_the_patterns():
    rnd = random.Random(5)
    for _ in range(20_000):
        text = "".join(rnd.choice("a1.@-+ 2(4%é") for _ in range(rnd.randint(0, 40)))
        assert sorted(pii.base_spans(text), key=lambda x: (x[0], list(_BASE).index(x[2]))) == _base(text), text


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("mail john [at] example [dot] com now", "john [at] example [dot] com"),
        ("write to john at example dot com", "john at example dot com"),
        ("jоhn@exаmple.com", "jоhn@exаmple.com"),
        ("j.doe＠ｅxample．com", "j.doe＠ｅxample．com"),
        ("ip １９２.168.0.1 x", "１９２.168.0.1"),
        ("one nine two dot one six eight dot one dot one", "one nine two dot one six eight dot one dot one"),
        ("call plus one five five five two three four five six seven eight", "plus one five five five two three four five six seven eight"),
        ("+1 five five five 123 4567 ok", "+1 five five five 123 4567"),
        ("card four five three two zero one five one one two eight three zero three six six", "four five three two zero one five one one two eight three zero three six six"),
        ("he was at home at ten, one or two of them", None),
        ("the dot on the i at the end", None),
    ],
)
def test_disguises(text, found):
    base, added = pii.scan(text)
    assert base == [] and [text[a:b] for a, b, _ in added] == ([found] if found else [])


@pytest.mark.parametrize(
    "text",
    [
        "192 point 168 point 0 point 1", "192\tdot\t168\tdot\t0\tdot\t1", "192.168_dot_0.1", "john_at_example.com", "john-at-example.com", "john[at]example.com", "john at example\tdot\tcom",
        "john@example point com", "+1 five 55 5 one 23 4567", "+1 555 12 3 seven 56", "plus 1 555 123 4567", "4532 0151 1283 03 six 6",
    ],
)
def test_each_disguise_alone(text):
    base, added = pii.scan(text)
    assert base == [] and [text[a:b] for a, b, _ in added] == [text]
    for other in ("x", "[at]", "exаmple", "one two three four"):  # other disguises in the text change nothing
        both = f"{other}; {text}"
        assert [both[a:b] for a, b, _ in pii.scan(both)[1]] == [text]


def test_signs_miss_no_match():
    rnd = random.Random(9)
    pieces = ["at", "dot", "point", "@", "plus", "+", "ONE", "ſix", "fİve", "oh", "7", "42", " ", " ", "\t", "\n", "_", "-", ".", ",", "(", ")", "[", "]", "a", "é"]
    fired = [0, 0, 0]
    for _ in range(60_000):
        text = "".join(rnd.choices(pieces, k=rnd.randint(1, 24)))
        matches = pii._AT.search(text), pii._DOT.search(text), any(pii._PIECE.search(m[0]) for m in pii._DIGIT_RUN.finditer(text))
        for k, (sign, match) in enumerate(zip(pii.signs(text), matches, strict=True)):
            assert sign or not match, text
            fired[k] += bool(match)
    assert min(fired) > 100


def test_added_spans_leave_base_ones(spark):
    texts = ["a@b.co and c [at] d [dot] org, 10.0.0.1", None, "", "x" * 200_000 + " a@b.co", "a@b.co"]
    df = spark.createDataFrame([(k if k != 4 else None, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, spans int")
    rows = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert (rows[0].n_email, rows[0].n_ip, rows[0].n_added, rows[0].spans) == (1, 1, 1, "email:0:6,email:11:29,ip:31:39")
    assert rows[0].base_sha256 == hashlib.sha256(b"email:0:6,ip:31:39").hexdigest() and rows[1].spans == "" and rows[None].n_email == 1
    assert rows[1].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[3].spans == "email:200001:200007"
    assert pii.find_spans(df.limit(0)).count() == 0


# ---------------------------------------------------------------- decontamination


def _edited(rnd, words, k, vocabulary):
    words = list(words)
    for _ in range(k):
        p = rnd.randrange(len(words))
        what = rnd.choice("sid")
        if what == "i":
            words.insert(p, rnd.choice(vocabulary))
        elif what == "s" or len(words) < 4:
            words[p] = rnd.choice(vocabulary)
        else:
            del words[p]
    return words


@pytest.mark.parametrize("n", [6, 10, 25, 55])
def test_recall_at_the_limit(n):
    rnd = random.Random(2)
    vocabulary = [f"w{k}" for k in range(500)] + ["the"] * 150
    items = [[rnd.choice(vocabulary) for _ in range(n)] for _ in range(150)]
    index, k = dc.Index(list(range(150)), [" ".join(x) for x in items]), int(dc.allowed(np.array([n]))[0])
    pad = lambda: [rnd.choice(vocabulary) for _ in range(30)]
    docs = [" ".join(pad() + _edited(rnd, x, k, vocabulary) + pad()) for x in items]
    hit = set()
    for first, raw, at in chunks(pa.array(docs)):
        t, i, _ = index.find(Words(raw, at, NO_LETTER, latin=True))
        hit |= {(int(a) + first, int(b)) for a, b in zip(t, i, strict=True)}
    assert sum((j, j) in hit for j in range(150)) / 150 >= dc.RECALL


@pytest.mark.parametrize("n", [6, 10, 25, 55, 200])
@pytest.mark.parametrize("side", ["begins", "ends", "is all"])
def test_recall_at_the_edges_of_a_text(n, side):
    rnd = random.Random(11)
    vocabulary = [f"w{k}" for k in range(500)] + ["the"] * 150
    items = [[rnd.choice(vocabulary) for _ in range(n)] for _ in range(150)]
    index, k = dc.Index(list(range(150)), [" ".join(x) for x in items]), int(dc.allowed(np.array([n]))[0])
    pad = lambda: [rnd.choice(vocabulary) for _ in range(30)]
    docs = {
        "begins": [x[k:] + pad() for x in items], "ends": [pad() + x[: n - k] for x in items], "is all": [x[k // 2 : n - (k - k // 2)] for x in items],
    }[side]
    hit = set()
    for first, raw, at in chunks(pa.array([" ".join(d) for d in docs])):
        t, i, _ = index.find(Words(raw, at, NO_LETTER, latin=True))
        hit |= {(int(a) + first, int(b)) for a, b in zip(t, i, strict=True)}
    assert sum((j, j) in hit for j in range(150)) / 150 >= dc.RECALL


def _distance(a, b):
    """Edit distance of ``a`` to any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination(spark):
    rnd = random.Random(3)
    vocabulary = [f"v{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 30)))) for k in range(20)] + [(None, "only once here you see"), (77, None), (78, " , ")]
    rows = [(None, "x only ONCE here, you see!", "a"), (0, None, "a"), (1, "", "a"), (2, "z " * 50_000, "a")]
    for d in range(3, 60):
        words = [rnd.choice(vocabulary) for _ in range(40)]
        if d % 2:
            words[10:10] = _edited(rnd, items[d % 20][1].split(), d % 3, vocabulary)
        rows.append((d, "### ".join(words), "a"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t, _ in rows:
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        for i, text in items:
            item = re.findall(r"[a-z0-9]+", (text or "").lower())
            k = 0 if len(item) < 6 else int(0.2 * len(item) + 1e-9)
            if item and w and len(w) < 1000 and (dist := _distance(item, w)) <= k:
                want.add((d, i, dist))
    got = {(r.doc_id, r.item_id, r.distance) for r in dc.find_items(docs, bench).collect()}
    assert got <= want and len(want - got) <= 0.02 * len(want) and (None, None, 0) in got
    clean = dc.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _, _ in got}
    assert dc.find_items(docs, bench.limit(0)).count() == 0 and dc.decontaminate(docs.limit(0), bench).count() == 0


# ---------------------------------------------------------------- rendering


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("<p>One<p>Two <b>bold</b>text<br>line", "One\n\nTwo boldtext\nline"),
        ("<head><title>t</title></head><body>a<script>if (a<b) '</p>'</script> b<style>x</style><!-- c --></body>", "a b"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><caption>Cap</caption><tr><th>Name<th>V<tr><td>longer name<td>1<tr><td>z<td hidden>no</table>", "Cap\nName        | V\nlonger name | 1\nz"),
        ("a<div hidden>no</div><span style='display: none'>no</span><p aria-hidden=true>no</p>b", "ab"),
        ("<pre>a\n  b</pre>c", "a\n  b\n\nc"), ("x &amp; y &lt;z&gt; <img alt='pic'>", "x & y <z> pic"), ("</p></div>1 < 2 <", "1 < 2 <"), ("<h1>T</h1><div>a</div><div>b</div>", "T\n\na\nb"),
    ],
)
def test_render(html, text):
    assert rd.render_page(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table>a<tr>b<form><td>c</form><div>d</div><tbody>e</table>", "ab\nd\ne\nc"), ("<table><form><tr><td>a<td>b</form></table>", "a | b"), ("<table><colgroup><col><tr><td>a</table>", "a"),
        ("<table><tr><td>a<img alt=pic><td>b</table>", "apic | b"), ("<select><option>a<option>b</select> <textarea>x &amp; y</textarea>", "a b x & y"),
        ("<svg><title>no</title><text>s</text></svg> <math><mi>m</mi></math> <object>o</object>", "s m o"), ("<table><tr><td>h<ul><li>a<li>b</ul><p>t</table>", "h\n\n- a\n- b\n\nt"),
        ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb"), ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td>" + "x" * 70 + "<td>b<tr><td>c<td>d</table>", "x" * 70 + " | b\nc" + " " * 69 + " | d"), ("<div>" * 600 + "<div hidden>no<div>no</div>no</div>yes", "yes"),
        ("<table><tr><td>o<table><tr><td>a<td>b</table><td>z</table>", "o     | z\n\na | b"),
    ],
)
def test_render_leaves_nothing_out(html, text):
    assert rd.render_page(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div style="visibility:hidden">no <b style="visibility: visible">yes</b> no<hr><img alt=no></div>after', "yes\nafter"),
        ('<div style="visibility:hidden;visibility:visible">yes</div><p style="display:none; display:block">too', "yes\n\ntoo"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<div style='-webkit-display:none'>yes", "yes"),
        ("<form>Name <input value=Ann><input type=hidden value=no><input type=password value=no><input type=submit value='Send now'></form>", "Name Ann Send now"),
        ("<div>" * 600 + "<p hidden>no</p><p style='visibility:hidden'>no <i style='visibility:visible'>yes</i></p>end", "yes\n\nend"),
        ("<p title='" + "a \"b\" " * 3000 + "'" + " x=\"1\"" * 3000 + ">yes", "yes"),
    ],
)
def test_render_what_is_visible(html, text):
    assert rd.render_page(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<head><title>t</title><p>visible", "visible"), ("<html><head><style>x</style>text", "text"), ("<head><meta charset=utf-8>\n <link rel=x>\n<div>a</div></head><p>b", "a\n\nb"),
        ("<!doctype html><title>t</title>a<head>b</head><title>u</title>c", "abc"), ("<head></head> <title>t</title><body>a", "a"), ("<p>a<head hidden>b", "ab"),
        ("<head><script>no</script><noscript>no</noscript><template><p>no</p></template><base>yes", "yes"),
        ('<div class="a"">lost</div>kept<p title="x">z', "lost\nkept\n\nz"), ("<a href=x<y>z</a>", "z"), ("<p title=it's>a <b title=\"x>y\">c</b> d's", "a c d's"), ("a<b x='>' y=\">\" z>c", "ac"),
        ("a<b", "a"), ("a <p title='unclosed>b <i>c</i>", "a\n\nb c"), ("x<a =\">\">y", "xy"),
        ("<details>no<summary>head</summary>no</details><details open>yes<summary>s</summary></details>", "head\nyes\ns"),
        ("<blockquote>q<ul><li>a<ul><li>b</ul></ul></blockquote>c", "  q\n\n  - a\n    - b\n\nc"), ("<ol><li value=7>a<li>b<li value=x>c</ol>", "7. a\n8. b\n9. c"),
    ],
)
def test_render_as_browsers_do(html, text):
    assert rd.render_page(html) == text


def test_broken_tags_take_time_in_proportion():
    """Tags that nothing closes, and quotes without an end."""
    for piece in ("<a ", "<a x=\"", "<a x='", "<a =", "<p title=it's ", "<a b=c\"d", "<a \"", "</a "):
        began = time.monotonic()
        rd.render_page(piece * 100_000)
        assert time.monotonic() - began < 10


def _page(rnd, depth, shown, gone, out):
    """Random html; notes the words in sight in ``out``."""
    parts = []
    for _ in range(rnd.randint(1, 4)):
        if depth == 0 or rnd.random() < 0.3:
            word = f"w{rnd.randrange(10**9)}"
            parts.append(word)
            if shown and not gone:
                out.append(word)
            continue
        look, here, away = "", shown, gone
        kind = rnd.random()
        if kind < 0.1:
            look, away = rnd.choice((" hidden", " style='display:none'", " aria-hidden=true")), True
        elif kind < 0.2:
            look, here = " style='visibility:hidden'", False
        elif kind < 0.3:
            look, here = " style='color:red;visibility:visible'", True
        tag = rnd.choice("div section span b ul table dl pre textarea script".split())
        if tag in ("textarea", "script"):
            word = f"w{rnd.randrange(10**9)}"
            parts.append(f"<{tag}{look}>{word}</{tag}>")
            if tag == "textarea" and here and not away:
                out.append(word)
            continue
        inner = lambda d=depth - 1, h=here, a=away: _page(rnd, d, h, a, out)
        if tag == "ul":
            body = "".join(f"<li>{inner()}" + rnd.choice(("", "</li>")) for _ in range(2))
        elif tag == "dl":
            body = f"<dt>{inner()}<dd>{inner()}"
        elif tag == "table":
            cell = lambda: f"<{rnd.choice(('td', 'th'))}{rnd.choice(('', ' rowspan=2', ' colspan=3'))}>{inner()}"
            body = rnd.choice(("", inner())) + "".join(f"<tr>{cell()}{cell()}" for _ in range(2)) if rnd.random() < 0.5 else f"<tbody><tr>{inner()}{cell()}</tbody>"
        else:
            body = inner()
        parts.append(f"<{tag}{look}>{body}</{tag}>")
    return " ".join(parts)


@pytest.mark.parametrize("seed", range(150))
def test_render_all_that_is_visible_and_nothing_else(seed):
    rnd, out = random.Random(seed), []
    html = _page(rnd, 4, True, False, out)
    assert sorted(re.findall(r"w[0-9]+", rd.render_page(html))) == sorted(w for w in re.findall(r"w[0-9]+", html) if w in set(out))


def test_render_is_linear_and_keeps_columns(spark):
    for bad in ("<" * 50_000, "<a " * 50_000, '<a "' * 50_000, "<div>" * 30_000 + "x", "<table><tr><td>" * 10_000, "<!--" * 50_000, "<title>" * 20_000):
        rd.render_page(bad)
    df = spark.createDataFrame([(1, "u", "<p>hi", 5), (1, "u", "<p>hi", 5), (None, None, None, None)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or 0, r.text) for r in rd.render(df).collect()) == [(0, ""), (1, "hi"), (1, "hi")] and rd.render(df.limit(0)).count() == 0


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark):
    rnd = random.Random(7)
    plain, bad = [f"word{k}" for k in range(300)], ["nasty", "horrid", "vilest"]

    def text(toxic):
        words = [rnd.choice(plain) for _ in range(rnd.randint(20, 200))]
        for _ in range(rnd.randint(1, 4) if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(bad).upper()
        return " ".join(words)

    rows = [(k, text(k % 4 == 0), "e") for k in range(800)] + [(900, None, "e"), (901, "", "e"), (None, "nasty nasty", "e"), (902, "fine " * 40_000, "e"), (2, "again", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(0, 800, 2)] + [(900, None), (None, 1), (902, 0)], "doc_id long, toxic int")
    model = tox.train(docs, labels)
    out = {r.doc_id: r for r in tox.score(docs, model).where("doc_id is null or doc_id <> 2").collect()}
    held_out = [out[k] for k in range(1, 800, 2)]
    assert not any(r.toxic for r in held_out) and np.mean([out[k].toxic for k in range(0, 800, 4)]) > 0.95
    assert (out[900].severity, out[901].severity, out[902].toxic, out[None].toxic) == (0, 0, False, True) and all(0 <= r.severity <= 2 for r in out.values())
    kept = tox.score(docs, model, keep_harmless=True)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {900, 901, 902, 1}
    assert tox.score(docs, tox.train(docs.limit(0), labels)).where("toxic").count() == 0
    again = tox.train(docs.repartition(7), labels)
    assert all((a == b).all() for a, b in zip(model, again, strict=True))


def test_scores_against_plain_python():
    rnd, rng = random.Random(5), np.random.default_rng(5)
    dense, th = rng.standard_normal(1 << tox.BITS) * 0.1, np.array([0.3, 1.1])
    vocabulary = ["Straße", "ÉCOLEs", "naïvely", "a", "B2b", "characteristically", "characters", "x×y", "日本語の文", "don't", "UNDER_score"]
    texts = ["", None, " .,!", *(" ".join(rnd.choice(vocabulary) + rnd.choice(("", ",", "!?", "\n")) for _ in range(rnd.randint(1, 60))) for _ in range(40)), "characters " * 90_000]
    low = {c: chr(ord(c) + 32) for c in map(chr, [*range(65, 91), *range(0xC0, 0xDF)]) if c != "×"}

    def slot(piece, stem):
        hashed = Words(np.frombuffer(piece, np.uint8), np.array([0, len(piece)]), NO_LETTER, latin=True).hash[0]
        return int(hashed >> np.uint64(64 - tox.BITS)) & ~1 | stem

    def model(text):
        flat = "".join(low.get(c, c) for c in text or "")
        found = [w.encode() for w in re.findall(r"[0-9a-z\x80-\U0010ffff]+", flat)]
        counts = {}
        for w in found:
            counts[slot(w, 0)] = 1
        stems = [w[: tox.STEM] for w in found if len(w) >= tox.STEM + 2]
        score = sum(dense[k] for k in counts)
        for k in {slot(x, 1) for x in set(stems)}:
            score += dense[k] * np.log1p(100 * sum(slot(x, 1) == k for x in stems) / len(found)) if len(stems) < 1000 else 0
        if len(stems) >= 1000:  # the long text has one stem
            score += dense[slot(stems[0], 1)] * np.log1p(100.0)
        p = [1 / (1 + np.exp(-(score - t))) for t in th]
        return (sum(p), p[0]) if found else (0.0, 0.0)

    severity, p = tox.severities(pa.array(texts, pa.string()), dense, th)
    for k, text in enumerate(texts):
        assert np.allclose((severity[k], p[k]), model(text)), text[:80]


def test_thresholds_are_ordered_and_weights_shared():
    rng = np.random.default_rng(1)
    toxic = np.array([0, 1] * 60)
    slots = [np.unique(np.concatenate([rng.integers(10, 60, 12) * 2, [2] if t else []]).astype(np.int32)) for t in toxic]
    values = [np.ones(len(s), np.float32) for s in slots]
    on, w, th = tox.fit(toxic, slots, values)
    assert th[0] < th[1] and dict(zip(on, w, strict=True))[2] > 0 and set(np.unique(tox.grades(toxic, slots, values))) <= {0, 1, 2}
