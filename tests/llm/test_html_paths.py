import os
import time
from collections import defaultdict
from html.parser import HTMLParser

import pytest

from tidepanel.llm import html_paths as H
from tidepanel.llm.html_paths import extract, extract_report, main_text

LONG = "This is a sentence of the article, and it goes on for a while. It has some more to say, too."


def page(body, head="<title>T</title><script>var t='</p>';</script><style>p{}</style>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_keeps_the_article_and_drops_the_rest():
    body = f"""<header class=site><h1>Site</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><h1>Title &amp; more</h1><p>{LONG}<p>Second   <b>bold</b>\n text.<br>After<ul><li>One</li><li>Two</ul><div class="ad">Buy now!</div><blockquote>Quote &lt;b&gt;</blockquote>
    <form><input><button>Go</button></form><section id="comments"><p>{LONG}</p></section></article><aside>Side {LONG}</aside><footer>&copy; 2020</footer><!-- <p>no</p> -->"""
    assert main_text(page(body)) == f"Title & more\n{LONG}\nSecond bold text. After\nOne\nTwo\nQuote <b>"


def test_finds_a_container_without_an_article_tag():
    body = (
        f"<div id=top><a href=/>a</a> <a href=/b>b</a></div><div class=sidebar><ul><li><a>x</a></li></ul></div><div "
        f"class=post><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>Short.</p></div><div class='footer'>Foot</div>"
    )
    assert main_text(page(body)) == f"Head\n{LONG}\n{LONG}\nShort."


def test_edge_cases(spark):
    assert main_text(None) == main_text("") == main_text("<html></html>") == main_text("<script>x") == ""
    assert main_text("just text &eacute;\u00a0 here") == "just text é here"
    assert main_text("<article><p>cut off in a ta<b") == "cut off in a ta"
    assert main_text(f"<article><p>a < b and {LONG}</p><!-- open") == f"a < b and {LONG}"
    deep = "<div>" * 3000 + LONG
    assert main_text(deep) == LONG
    rows = [
        (1, "u", page(f"<article><p>{LONG}</p></article>")),
        (1, "u", None),
        (None, None, ""),
        (2, "v", page("<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"))
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n_chars int")
    out = extract_report(df).collect()
    assert [r["n_chars"] for r in out] == [len(LONG), 0, 0, 5000 * (len(LONG) + 1) - 1]
    assert extract_report(df.limit(0)).count() == 0
    assert extract(df, to="n_chars").columns == df.columns


LONGER = LONG + " " + LONG.replace("sentence", "second sentence")


def test_keeps_title_and_lead_beside_the_container():
    body = f"""<div id=m1><a href=/>Home</a> <a href=/n>News</a></div><div class=post><h1>Title</h1><p class=lead>{LONG}</p>
    <div class=entry>{"".join(f"<p>{LONGER}</p>" for _ in range(20))}<h3>Part</h3><ul><li>Item one</li></ul></div></div><div class=x9>All rights reserved</div>"""
    assert main_text(page(body)) == "\n".join(["Title", LONG, *[LONGER] * 20, "Part", "Item one"])


def test_keeps_every_part_of_several_containers():
    box = lambda k: f"<div class=row><h2>Head {k}</h2><p>{LONGER}</p><p>Short {k}.</p></div>"
    body = f"<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>{box(1)}{box(2)}</td></tr></table><article><p>{LONGER}</p></article><article><p>{LONGER}</p><p>End.</p></article><p class=z>(c) me</p>"
    assert main_text(page(body)) == "\n".join(["Head 1", LONGER, "Short 1.", "Head 2", LONGER, "Short 2.", LONGER, LONGER, "End."])


def test_paths_decide_without_telling_names():
    """The same boxes without any class: short ones and links go, by the ratios alone."""
    body = f"<div>Free trial now</div><div><a href=/1>Read more about this and that, too.</a></div><section><h2>Head</h2><p>{LONGER}</p><p>{LONGER}</p><p>Short.</p></section><div>(c) 2020</div>"
    assert main_text(page(body)) == f"Head\n{LONGER}\n{LONGER}\nShort."


@pytest.mark.parametrize("wrapper", ['<div class="site no-sidebar">', '<div class="content has-sidebar"><article>', '<div id="main-header-wrap">', '<div class="ad-free">', '<div class="post share">', '<div class="post category-social-science">', '<div class="widget"><div class="banner">'])
def test_names_do_not_drop_whole_pages(wrapper):
    inner = f"<h1>Title</h1><p>{LONGER}</p><p>{LONGER}</p><p>Short.</p>"
    end = "</article></div>" if "<article" in wrapper else "</div>" * wrapper.count("<div")
    body = f'<div class="menu"><a href=/>Home</a> <a href=/n>News</a></div>{wrapper}{inner}{end}<div class="cookie-notice">We use cookies, as all do. You may say no, of course.</div>'
    assert main_text(page(body)) == f"Title\n{LONGER}\n{LONGER}\nShort."


def test_names_still_count_beside_the_content():
    said = f"<p>{LONGER}</p>" * 8
    for name in ("comments", "comment-list", "cookie-notice", "sidebar-left", "ad", "related"):
        body = f'<article><h1>Title</h1><p>{LONGER}</p></article><div class="{name}">{said}</div>'
        assert main_text(page(body)) == f"Title\n{LONGER}", name
        body = f'<div class=post><h2>Title</h2><p>{LONGER}</p><p>{LONGER}</p></div><div id="{name}">{said[: len(said) // 2]}</div>'
        assert main_text(page(body)) == f"Title\n{LONGER}\n{LONGER}", name
    assert not H.telling("no-sidebar") and not H.telling("category-social") and H.telling("x sidebar-left") and H.telling("cookie_notice") and not H.telling("header", True)


def test_a_header_beside_the_text_gives_its_heading():
    body = f"<header class=site><h1>Site</h1></header><div class=post><header><h1>Title</h1><p>By me, today.</p></header><p>{LONGER}</p><p>{LONGER}</p></div>"
    assert main_text(page(body)) == f"Title\n{LONGER}\n{LONGER}"


def test_short_boilerplate_without_names_goes():
    body = f"<div class=a1>We use cookies.</div><div class=a2><h1>Title</h1><p>{LONGER}</p><p>{LONGER}</p><p>{LONGER}</p></div><div class=a3>Ann: nice!</div><div class=a4>(c) me</div>"
    assert main_text(page(body)) == f"Title\n{LONGER}\n{LONGER}\n{LONGER}"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_the_ratios_select(spark, monkeypatch):
    """Without a threshold other blocks come along, on real pages as well."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    before = [main_text(x) for x in pages]
    monkeypatch.setattr(H, "REACH", 0.0)
    changed = sum(main_text(x) != b for x, b in zip(pages, before))
    assert changed > len(pages) / 2


class Reference(HTMLParser):
    """An independent reading of well-formed pages: all blocks with their paths, then the scores in plain loops."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.blocks, self.fresh = [("", "", False, False)], [], True

    def handle_starttag(self, tag, attrs):
        if tag in H.VOID:
            return self.handle_data(" ") if tag == "br" else None
        name = " ".join(v or "" for k, v in attrs if k in ("class", "id")) if tag != "article" else ""
        never = tag in H.NEVER or tag == "header"
        self.open.append((tag, f"{tag}.{dict(attrs).get('class') or ''}", self.open[-1][2] or never, self.open[-1][3] or name in ("ad", "comment")))
        self.fresh = self.fresh or tag in H.BLOCKS

    def handle_endtag(self, tag):
        while self.open[-1][0] != tag:
            self.open.pop()
        self.open.pop()
        self.fresh = self.fresh or tag in H.BLOCKS

    def handle_data(self, data):
        if self.open[-1][0] in ("script", "style", "title") or self.fresh and not data.strip():
            return
        if self.fresh:
            places = tuple(k for k, x in enumerate(self.open) if x[0] in H.BLOCKS)
            self.blocks.append(
                {
                    "path": tuple(self.open[k][1] for k in places),
                    "never": self.open[-1][2],
                    "named": self.open[-1][3],
                    "text": "",
                    "linked": 0,
                    "article": any(x[0] == "article" for x in self.open),
                    "n": 0,
                    "marks": 0
                }
            )
            self.fresh = False
        b = self.blocks[-1]
        b["text"] += data
        b["n"] += len(data.strip())
        b["marks"] += sum(c in ".,;:!?…。，；！？" for c in data)
        b["linked"] += len(data.strip()) if any(x[0] == "a" for x in self.open) else 0

    def main_text(self):
        total = defaultdict(lambda: [0, 0, 0, 0])
        for b in self.blocks:
            for k, x in enumerate((b["n"], b["marks"], b["linked"], 1)):
                total[b["path"]][k] += x
        fused = []
        for b in self.blocks:
            t = total[b["path"]]
            fused.append((1 - t[2] / max(t[0], 1)) ** 2 * (0.05 if b["named"] else 1))
        for k, least in ((0, 0), (1, 0.5)):
            ratio = [total[b["path"]][k] / total[b["path"]][3] for b in self.blocks]
            usual = [0 if b["never"] else b["n"] * (0.05 if b["named"] else 1) for b in self.blocks]
            typical = sum(u * r for u, r in zip(usual, ratio)) / max(sum(usual), 1)
            x = [min(1, r / typical) if typical else 1 for r in ratio]
            for i in range(len(x)):
                near = [(0.7, x[i])] + [(0.15, x[j]) for j in (i - 1, i + 1) if 0 <= j < len(x)]
                smooth = sum(w * v for w, v in near) / sum(w for w, _ in near)
                fused[i] *= least + (1 - least) * (x[i] * smooth) ** 0.5
        mean = defaultdict(list)
        for b, f in zip(self.blocks, fused):
            mean[b["path"]].append(f)
        chosen = [not b["never"] and sum(mean[b["path"]]) / len(mean[b["path"]]) >= 0.25 for b in self.blocks]
        read = any(c and b["article"] for c, b in zip(chosen, self.blocks))
        out = [" ".join(b["text"].split()) for b, c in zip(self.blocks, chosen) if c or read and b["article"] and not b["never"] and not b["named"]]
        return "\n".join(x for x in out if x)


def test_agrees_with_a_reference_version(spark):
    import random

    rng = random.Random(8)

    def words(n):
        return " ".join(rng.choice(["word", "and,", "then.", "more", "text;", "so"]) for _ in range(n))

    for _ in range(200):
        parts = [
            "<nav><ul><li><a href=/x>X</a></li></ul></nav>",
            f'<div class="ad">{words(rng.randint(1, 60))}</div>',
            f'<div class="k{rng.randint(0, 3)}">{words(rng.randint(1, 9))}</div>',
            f'<div class="links"><a href=/>{words(12)}</a> | <a href=/>{words(3)}</a></div>'
        ]
        rng.shuffle(parts)
        inner = "".join(
            rng.choice(
                [
                    f"<p>{words(rng.randint(1, 80))}</p>",
                    f"<h2>{words(3)}</h2>",
                    f"<ul><li>{words(2)}</li><li><a href=/>{words(2)}</a></li></ul>",
                    f'<div class="comment"><p>{words(40)}</p></div>',
                    f"<p><b>{words(4)}</b> &amp; {words(20)}<br>{words(2)}</p>"
                ]
            ) for _ in range(rng.randint(1, 12))
        )
        source = page(
            "".join([*parts[:2], f"<article><h1>{words(4)}</h1><p>{words(90)}</p>{inner}</article>", *parts[2:], "<footer>&copy; foot</footer>"])
        )
        reference = Reference()
        reference.feed(source)
        assert main_text(source) == reference.main_text()


def test_hostile_pages_take_linear_time():
    began = time.time()
    for source in (
        "<article>" + "<p>it's <b x='1>word" * 20000,
        "<div>" * 20000 + "x" + "</b></div>" * 20000,
        "<b>" + "<div>x</b>" * 20000,
        '<a href="' * 20000 + "'",
        "<!--" * 20000 + "<x y" * 20000
    ):
        main_text(source)
    assert time.time() - began < 15
