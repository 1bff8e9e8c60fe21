"""Line dedup, decontamination, URL filter, HTML extraction, quality, chat: brute force and edge cases."""

import json
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.llm import chat, decontaminate, html, lines, quality, urls
from tamis.llm.registry import RULES


def plain_line_dedup(rows, width=3):
    solid = {}
    for i, t in set(rows):
        ls = (t or "").split("\n")
        solid[(i, t)] = [(k, x.strip(" \t\r")) for k, x in enumerate(ls) if x.strip(" \t\r")]
    order = sorted(solid, key=lambda r: (r[0] is None, r[0] or 0))
    first, later = {}, []
    for r in order:
        for n in range(len(solid[r]) - width + 1):
            w = tuple(x for _, x in solid[r][n : n + width])
            if w in first:
                later.append((r, n, first[w]))
            else:
                first[w] = (r, n)
    gone = {r: set() for r in order}
    for r, n, (fr, fn) in later:
        gone[r] |= {n + j for j in range(width) if not (r == fr and n + j < fn + width)}
    out = {}
    for i, t in order:
        drop = {solid[(i, t)][n][0] for n in gone[(i, t)]}
        out[(i, t)] = t if not drop else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop)
    return out


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(6)
    pool = [f"line {k}" for k in range(12)] + ["", "  ", "x\t"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(80)]
    rows += [(200, "a\na\na\na\na\na\nb"), (201, None), (202, ""), (203, "a\na\na"), (204, rows[4][1]), (204, rows[4][1]), (None, "line 1\nline 2\nline 3\nline 1\nline 2\nline 3\r"), (205, "word " * 40000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("r")).withColumn("solid", F.lit(2))
    got = lines.line_dedup(df)
    assert got.columns == df.columns
    want = plain_line_dedup(rows)
    assert sorted(repr((x.doc_id, x.text)) for x in got.collect()) == sorted(repr((i, want[(i, t)])) for i, t in rows)
    assert lines.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edits(item, text):
    """The least edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def squeezed(t):
    return " ".join(re.findall(r"[^\W_]+", t.lower()))


@pytest.mark.parametrize("part", [decontaminate.PART, 700])
def test_decontamination_matches_alignment_of_everything(spark, part, monkeypatch):
    monkeypatch.setattr(decontaminate, "PART", part)
    r = random.Random(8)
    words = ["the", "of", "thand", "inger", "blest", "éauou", "whon", "ndre", "ationes", "to"]
    say = lambda n: " ".join(r.choice(words) + r.choice(["", ",", "."]) for _ in range(n))
    items = [(k, say(r.randint(9, 40))) for k in range(12)] + [(50, "tiny"), (51, ""), (52, None), (53, "...")]
    items += [(70, "oh, 1234567"), (71, "to be or not to be"), (72, "whon ndre to the ationes of"), (73, "inger thand blest, ndre of the whon")]
    many = decontaminate.indexes([x for x in items if x[1]], 8, 0.1)
    assert {index.q for index in many} >= {5, 8} and all((index.least >= 1).all() or index.short for index in many)
    for _ in range(60):
        k, t = items[r.choice([*range(12), -1, -2, -3, -4])]
        cut = list(squeezed(t))
        for _ in range(int(len(cut) * r.choice([0, 0.02, 0.06, 0.1, 0.15]))):
            at = r.randrange(len(cut))
            cut[at : at + r.randint(0, 1)] = r.choice(["", "q", "zz"[:1]])
        text = f"{say(60)} {''.join(cut).upper()} {say(60)}"
        found = decontaminate.find(text, many)
        for (k, n), i in {(k, n): i for k, index in enumerate(many) for n, i in enumerate(index.ids)}.items():
            index = many[k]
            want = squeezed(dict(items)[i])
            least = edits(want, squeezed(text))
            if len(want) < 8:
                assert ((k, n) in found) == (f" {want} " in f" {squeezed(text)} ")
            else:
                assert index.budget[n] == len(want) // 10
                assert ((k, n) in found) == (least <= index.budget[n]), (i, least)
                if (k, n) in found:
                    assert found[k, n][0] == least
                    assert edits(want, squeezed(text[found[k, n][1] : found[k, n][2]])) == least


def test_repetitive_texts_and_items_stay_small():
    many = decontaminate.indexes([(1, "ha " * 700)], 8, 0.1)
    tracemalloc.start()
    found = decontaminate.find("ha " * 20_000, many)
    assert found == {(0, 0): (0, 0, 2099)} and tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_decontamination_tables(spark):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again"), (2, None), (3, "tiny"), (1, "the quick brown fox jumps over the lazy dog again")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "xx The QUICK, brown fox - jumps over the lazy dog again! yy"), (2, "nothing"), (3, None), (4, ""), (1, "a tiny thing"), (None, "tinyish")], "doc_id long, text string").withColumn("item_id", F.lit(9))
    for block in (1 << 22, 30):
        got = sorted((r.doc_id, r.item_id, r.n_edits, r.start, r.end) for r in decontaminate.contaminated(docs.select("doc_id", "text"), bench, block_chars=block).collect())
        assert got == [(1, 1, 0, 3, 55), (1, 1, 0, 3, 55), (1, 3, 0, 2, 6)]
        kept = decontaminate.drop_contaminated(docs, bench, block_chars=block)
        assert kept.columns == docs.columns
        assert sorted(repr(r.doc_id) for r in kept.collect()) == ["2", "3", "4", "None"]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs.select("doc_id", "text"), none).count() == 0
    assert decontaminate.drop_contaminated(docs, none).count() == 6
    assert decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"), bench).count() == 0


def test_urls(spark):
    rows = [
        (1, "HTTP://WWW.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"),
        (2, "http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        (3, "http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        (4, "http://badexample.org/es/2", "badexample.org", "/es/2", "org/", "allow"),
        (5, "http://a.com/de/casino", "a.com", "/de/casino", "com/de/", "block"),
        (6, "http://a.com/fr/casino", "a.com", "/fr/casino", "com/fr/", "allow"),
        (7, "http://casino.net/", "casino.net", "/", None, "block"),
        (8, "http://casinos-and-more.net", "casinos-and-more.net", "", None, "block"),
        (9, "http://mycasino.net/", "mycasino.net", "/", None, "allow"),
        (10, "http://cheap.net/pills", "cheap.net", "/pills", None, "block"),
        (11, "http://cheap.net/cheap/cheaply", "cheap.net", "/cheap/cheaply", None, "allow"),
        (12, None, "", "", None, "allow"),
        (13, "no scheme/casino", "", "", None, "block"),
        (14, "", "", "", None, "allow"),
        (15, "http://example.org", "example.org", "", None, "allow"),
        (16, "x://h?a=://b/c", "h", "", None, "allow"),
        (16, "x://h?a=://b/c", "h", "", None, "allow"),
        (None, "http://é.net/Ü\nx", "é.net", "/Ü\nx", None, "allow"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = urls.filter_urls(df, RULES).collect()
    assert sorted(repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got) == sorted(repr((r[0], *r[2:])) for r in rows)
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
    own = urls.vocabulary(["# mine", "Bad\t2", "meh\t1", "worse # strict", ""])
    assert own == {"bad": 2, "meh": 1, "worse": 2}
    few = spark.createDataFrame([(1, "x://a/bad"), (2, "x://a/meh-meh"), (3, "x://casino/"), (4, "x://a/badly")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.n_strict, r.n_soft) for r in urls.filter_urls(few, [], terms=own).collect()} == {1: ("block", 1, 0), 2: ("allow", 0, 1), 3: ("allow", 0, 0), 4: ("allow", 0, 0)}
    assert {r.verdict for r in urls.filter_urls(few, [], terms={}).collect()} == {"allow"}


PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class=\"ad\">Buy</div><article><h1>{h}</h1><p>{a} &amp; <b>b</b>old&nbsp;x<br>next<p>Read this first.</p><div class='user-comments'>no</div><form>f</form></article><aside>s</aside><footer>&copy; us</footer></body></html>"


ODD = {
    30: (None, ""),
    31: ("", ""),
    32: ("just text &lt;b&gt;", "just text <b>"),
    33: ("<p>a<p>b</b></i>c < d", "a bc < d"),
    34: ("<div class='content'><h2>T</h2>x<ul><li>1<li>2</ul></div><div id=sidebar>s</div>", "T x 1 2"),
    35: ("<main>m</main><p>outside</p>", "m"),
    36: ("<p>" + "long " * 30000 + "</p>", "long " * 29999 + "long"),
    37: ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    38: ("<p hidden>kept</p><p>yes<!-- c", "kept yes"),
    39: ("<textarea><p>x</p></textarea>z<script>if(a<b){", "z"),
    40: ("<div class='content-sidebar-wrap'><article>a</article><div class='sidebar'><article>teaser</article></div></div>", "a"),
    41: ("<div class='ad-container'><p>buy</p></div><div class='text'>t<div class='cookie-notice'>n</div></div>", "t"),
    42: ('<article><h2 id="search">Search algorithms</h2><p id="comments">On comments</p><div class="related work">R</div><section id="notice">N</section><p>Price list now</p></article>', "Search algorithms On comments R N Price list now"),
    43: ("<article><p>x</p><div class='user-comments'>no</div><form>f</form></article><aside>s</aside>", "x"),
    44: ("<div id=a><a href=/>m</a></div><div id=b><h1>T</h1><div>a longer body</div></div>", "T a longer body"),
    45: ("a <b c", "a <b c"),
}


def test_html(spark):
    pages = [(i, "http://one.net/%d" % i, PAGE.replace("{h}", f"Head {i}").replace("{a}", f"para {i}\n  end")) for i in range(20)]
    want = {i: f"Head {i} para {i} end &" for i in range(20)}  # the rest stands alike on every page of the host
    pages += [(25, "http://two.net/1", PAGE.replace("{h}", "H").replace("{a}", "p"))]
    want[25] = "H p & bold x next Read this first."  # one page shows no template
    pages += [(i, None if i == 30 else f"http://odd{i}.net/", h) for i, (h, _) in ODD.items()]
    pages += [pages[0], pages[0]]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("of_host", F.lit(1))
    got = html.extract(df).collect()
    assert len(got) == len(pages)
    for r in got:
        text = want[r.page_id] if r.page_id in want else ODD[r.page_id][1]
        assert (r.text, r.n_chars) == (text, len(text)), r.page_id
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page", ["<a" * 20000, "<b>" * 20000 + "</i>" * 20000, '<a "' * 20000, '<a ">"' * 20000, "<b><div>" + "<i>" * 20000 + "</b>" * 20000, "<ul><li>" * 10000 + "</li>" * 10000, "<" * 50000, "<!--" * 20000, "<script>" * 20000, "<a class='" * 20000, "<div>" * 20000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    html.main_text(page)
    html.page_tokens(page)
    assert time.process_time() - began < 3


def unnamed(i, text, odd=False):
    """A page whose elements say nothing of their roles."""
    if odd:
        return "<html><body><p>Sorry, gone.</p></body></html>"
    menu = f"<div class=x1><p>Choose one of many fine things to read here today {i % 3}</p><p>All rights are with us, as they always were.</p></div>"
    return f"<html><body>{menu}<div class=x2><h2>Part {i}</h2><p>{text}</p></div><div class=x3><p>Made with care number {i % 2}.</p></div></body></html>"


def test_the_template_decides_where_names_say_nothing(spark):
    long = "running text that only this page has, at some length "
    rows = [(i, "http://h.net/%d" % i, unnamed(i, f"{long * 3}{i}" if i % 4 else "short")) for i in range(24)]
    rows += [(50, "http://h.net/odd", unnamed(0, "", odd=True)), (51, "http://h.net/null", None)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(24):
        assert got[i] == " ".join(f"Part {i} {long * 3 + str(i) if i % 4 else 'short'}".split())
    assert html.main_text(rows[0][2]) != got[0]  # by itself, the page looks like its menu
    assert got[50] == "Sorry, gone." and got[51] == ""


def test_classes_match_brute_force(spark):
    r = random.Random(9)
    parts = ["<div class=a><p>one</p></div>", "<div class=b><h3>two</h3><p>same</p></div>", "<ul><li>x</li></ul>", "<section><h4>s</h4></section>"]
    pages = [(h, f"http://{h}.net/", "<body>" + "".join(x for x in parts if r.random() < 0.7) + f"<p>{r.randint(0, 3)}</p></body>") for h in ("p", "q") for _ in range(60)]
    got = {t.host: t for t in html.deduce_templates(spark.createDataFrame([(i, u, x) for i, (_, u, x) in enumerate(pages)], "page_id long, url string, html string"), share=0.3, text_share=0.6).collect()}
    for h in ("p", "q"):
        mine = sorted({x for k, _, x in pages if k == h})
        vectors, above, is_text = {}, {}, {}
        for at, page in enumerate(mine):
            for token, n, up, _, _, text in html.page_tokens(page):
                vectors.setdefault(token, [0] * len(mine))[at] = n
                above[token], is_text[token] = up, text
        lower = lambda k, n, z=1.96: (k / n + z * z / (2 * n) - z * ((k / n * (1 - k / n) + z * z / (4 * n)) / n) ** 0.5) / (1 + z * z / n)
        alive = {t for t, v in vectors.items() if sum(map(bool, v)) > 1 and lower(sum(map(bool, v)), len(mine)) >= (0.6 if is_text[t] else 0.3)}
        while True:
            classes = {}
            for t in alive:
                up = above[t]
                while up and (up not in alive or vectors[up] == vectors[t]):
                    up = above[up]
                classes.setdefault((tuple(vectors[t]), tuple(vectors[up]) if up else ()), set()).add(t)
            kept = {t for c in classes.values() if len(c) > 1 for t in c}
            if kept == alive:
                break
            alive = kept
        elements = {frozenset(t for t in c if not is_text[t]) for c in classes.values()} - {frozenset()}
        found = {}
        for t, c in zip(got[f"{h}.net"].tokens, got[f"{h}.net"].classes, strict=True):
            found.setdefault(c, set()).add(t)
        assert {frozenset(c) for c in found.values()} == elements and len(elements) > 2
        assert set(got[f"{h}.net"].texts) == {t for t in alive if is_text[t]}


def test_a_class_counts_in_its_order_only():
    first, second = "<body><div class=a><p>menu words</p></div><div class=b><p>text</p></div></body>", "<body><div class=b><p>text</p></div><div class=a><p>menu words</p></div></body>"
    tokens = [html.element_token(x) for x in html.parse(first).path[1:]]
    template = html.Template(dict.fromkeys(tokens, 7), {t: float(k) for k, t in enumerate(tokens)}, dict.fromkeys(tokens, 1.0))
    assert html._in_order(html.parse(first), template) == {7}
    assert html._in_order(html.parse(second), template) == set()


def test_quality_learns_and_edges(spark):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "epsilon,", "zeta."]) for _ in range(60))
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "WIN!!", "$$$", "FREE!!"]) for _ in range(60))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x" * 200000), (None, good()), (5, good())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 400)] + [(None, 1), (7, None), (1, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    right = [x.predicted == int(x.doc_id % 3 > 0) for x in got if x.doc_id is not None and x.doc_id < 400 and x.held_out]
    assert len(right) > 60 and np.mean(right) > 0.97
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id % 3 = 0 AND doc_id < 400").count() <= 3
    none = quality.classify(docs, labels.where("quality > 5")).collect()
    assert {x.score for x in none} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_held_out_labels_are_never_learnt(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"text {i} " * (i % 5 + 1)) for i in range(200)], "doc_id long, text string")
    flip = lambda f: spark.createDataFrame([(i, int(f(i))) for i in range(200)], "doc_id long, quality int")
    held = {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}
    a = quality.classify(docs, flip(lambda i: i % 5 > 1)).collect()
    b = quality.classify(docs, flip(lambda i: (i % 5 > 1) ^ (i in held))).collect()
    assert sorted(a) == sorted(b)
    assert {x.doc_id for x in a if x.held_out} == held


def test_chat_links_orders_and_validates(spark):
    call = lambda i, name, **a: "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": a}) + "</tool_call>"
    result = lambda i, c="ok": json.dumps({"tool_call_id": i, "content": c})
    tools = {"search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"], "additionalProperties": False}}
    rows = [
        (1, 0, "user", "hi\n\"é\""),
        (1, 1, "tool", result("a")),  # before its call
        (1, 2, "assistant", "sure " + call("a", "search", query="x", limit=2)),
        (1, 3, "assistant", call("b", "search", query={"$ref": "c"})),  # needs c, called later
        (1, 4, "assistant", call("c", "search", limit=0)),  # breaks the schema twice
        (1, 6, "tool", result("c")),
        (1, 7, "tool", result("b")),
        (2, 0, "assistant", call("a", "nope") + call("p", "search", query={"$ref": "q"}) + "<tool_call>{bad</tool_call>"),
        (2, 1, "assistant", call("q", "search", query={"$ref": "p"})),  # a circle
        (2, 2, "tool", result("zz")),
        (2, 3, "tool", "not json"),
        (2, 4, "assistant", call("a", "search", query="again", extra=1)),  # identifier again
        (3, 0, None, None),
        (None, 0, "assistant", call("a", "search", query="x")),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("place", F.lit("clash"))
    got = {(r.conv_id, r.turn): r for r in chat.format_chats(df, tools).collect()}
    assert len(got) == len(rows)
    g = lambda c, t: (got[c, t].place, got[c, t].step, got[c, t].n_calls, got[c, t].n_linked, got[c, t].n_faults)
    assert got[1, 0].message == '{"content":"hi\\n\\"é\\"","role":"user"}' and g(1, 0) == (0, 0, 0, 0, 0)
    assert g(1, 1) == (2, 1, 0, 1, 0)
    assert g(1, 2) == (2, 0, 1, 1, 0)
    assert got[1, 2].message == '{"content":"sure","role":"assistant","tool_calls":[{"arguments":{"limit":2,"query":"x"},"id":"a","name":"search"}]}'
    assert g(1, 3) == (6, 1, 1, 1, 0) and g(1, 4) == (4, 0, 1, 1, 2) and g(1, 6) == (6, 0, 0, 1, 0) and g(1, 7) == (7, 0, 0, 1, 0)
    assert g(2, 0) == (0, 0, 2, 0, 1 + 2 + 2)  # not JSON; a: unknown tool, no result; p: a circle, no result
    assert g(2, 1) == (1, 0, 1, 0, 2) and g(2, 2) == (2, 0, 0, 0, 1) and g(2, 3) == (3, 0, 0, 0, 1) and g(2, 4) == (4, 0, 1, 0, 2)
    assert got[3, 0].role == "" and got[3, 0].message == '{"content":"","role":""}'
    assert g(None, 0) == (0, 0, 1, 0, 0)
    assert chat.format_chats(df.limit(0), tools).count() == 0


def stands(conv):
    """The rows of a conversation in the order that the operator gives."""
    return [r.turn for r in sorted(conv, key=lambda r: (r.place, r.step, r.turn))]


@pytest.mark.parametrize("at_once", [10_000, 3])
def test_chat_order_against_brute_force(spark, at_once):
    """Every result after its call, every call after the results it names; what can't be is in a circle, and only that."""
    r = random.Random(12)
    rows, needs = [], {}
    for c in range(25):
        turns = list(range(14))
        r.shuffle(turns)
        ids = [f"k{i}" for i in range(5)]
        at = {i: turns.pop() for i in ids}
        back = {i: turns.pop() for i in ids if r.random() < 0.8}
        for i in ids:
            refs = [j for j in ids if j != i and r.random() < 0.25]
            rows.append((c, at[i], "assistant", "<tool_call>" + json.dumps({"id": i, "name": "f", "arguments": {"xs": [{"$ref": j} for j in refs]}}) + "</tool_call>"))
            needs[c, at[i]] = {back.get(j, at[j]) for j in refs}
        for i, t in back.items():
            rows.append((c, t, "tool", json.dumps({"tool_call_id": i, "content": 1})))
            needs[c, t] = {at[i]}
        rows += [(c, t, "user", "hm") for t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df, {"f": {"type": "object"}}, at_once=at_once).collect()
    key = {(x.conv_id, x.turn): (x.place, x.step, x.turn) for x in got}
    free = {k for k in key if not needs.get(k)}
    while more := {k for k in key if k not in free and all((k[0], t) in free for t in needs[k])}:
        free |= more
    assert 20 < len(key) - len(free) < len(key) - 100
    for (c, t), sources in needs.items():
        if (c, t) in free:
            assert all(key[c, t] > key[c, s] for s in sources)
            first = max(((*key[c, s][:2],) for s in sources), default=(-1, 0))
            assert key[c, t][:2] == ((t, 0) if t > first[0] else (first[0], first[1] + 1))
        else:
            assert key[c, t][:2] == (t, 0)


def test_a_long_chain_is_ordered_in_one_pass(spark):
    n = 400
    rows = [(1, n - i, "assistant", "<tool_call>" + json.dumps({"id": f"c{i}", "name": "f", "arguments": {"x": {"$ref": f"c{i - 1}"}} if i else {}}) + "</tool_call>") for i in range(n)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), {"f": {}}).collect()
    assert stands(got) == list(range(n, 0, -1))


def test_schemas():
    whole = {"type": "object", "properties": {"s": {"type": "string", "minLength": 2, "maxLength": 3, "pattern": "^a"}, "l": {"type": "array", "minItems": 1, "maxItems": 2, "uniqueItems": True, "items": {"type": "integer", "exclusiveMinimum": 0, "exclusiveMaximum": 9}}, "d": {"format": "date-time"}, "c": {"const": 1}, "e": {"enum": [1, "x"]}}, "additionalProperties": {"type": "null"}}
    ok = {"s": "abc", "l": [1, 8], "d": "2024-02-03T04:05:06Z", "c": 1, "e": "x", "other": None}
    assert chat.breaches(ok, whole) == []
    for part, n in (({"s": "a"}, 1), ({"s": "bcde"}, 2), ({"l": []}, 1), ({"l": [1, 1, 9]}, 3), ({"l": [0]}, 1), ({"d": "2024-02-03 04:05"}, 1), ({"c": True}, 1), ({"e": True}, 1), ({"more": 1}, 1), ({"s": {"$ref": "q"}}, 0), ({"s": 5}, 1)):
        assert len(chat.breaches(part, whole)) == n, part
    for bad in ({"oneOf": []}, {"properties": {"x": {"format": "hostname"}}}, {"items": {"typ": "string"}}):
        with pytest.raises(ValueError):
            chat.known_schema(bad)
    assert chat.parse("assistant", '<tool_call>{"id":"\\ud800","name":"f"}</tool_call>', {})["faults"] and "\\ud800" in chat.parse("tool", '{"tool_call_id":"a","content":"\\ud800"}', {})["message"]
    assert chat.parse("tool", "[" * 200_000, {})["faults"]
