"""HTML extraction: hidden elements, and pages of a writer that the trees never saw."""

import random
import re

import pytest

from pagegrain.llm import html


def text_of(source):
    return html.extract([source], html.model())[0]


@pytest.mark.parametrize("tag", ["label", "button", "svg", "canvas", "object", "audio", "video"])
def test_form_controls_and_embedded_elements_have_no_text(tag):
    inner = f"<{tag} class=x>hidden <b>words</b></{tag}>"
    body = "The first paragraph of an article has some words, and more of them follow here."
    page = f"<html><body><article><h1>A headline of some words</h1><p>{body} {inner}</p>{inner}<p>{body}</p><div>{inner}<p>{body}</p></div></article></body></html>"
    assert text_of(page) == "\n".join(["A headline of some words", body, body, body])


def test_what_nothing_ends_hides_nothing_and_a_block_ends_what_is_open():
    body = "A paragraph of the article with words enough to be one, it goes on for a while."
    page = f"<article><p>{body} <label>Name</p><p>{body}</p><p>{body} <button>{body}</p><p>{body}</p></article><p><label>x</label></p>"
    assert text_of(page).split("\n")[:2] == [body, body]
    assert text_of(f"<article><p>{body} <svg/>{body}</p><p>{body}</p></article>") == f"{body} {body}\n{body}"
    assert text_of(f"<article><p>{body}</p><select><option>a<option>b</select><input value=x><p>{body}</p></article>") == f"{body}\n{body}"


def other_page(rnd):
    """A page and its main text, in another writer's layout: no article element, other tokens, blocks of divs and tables."""
    words = "river stone green letter morning office window paper quiet number simple against through market".split()
    say = lambda lo, hi: " ".join(rnd.choice(words) for _ in range(rnd.randint(lo, hi))).capitalize() + "."
    para = lambda: " ".join(say(6, 16) for _ in range(rnd.randint(2, 5)))
    main = [say(3, 7)] + [para() for _ in range(rnd.randint(3, 7))]
    menu = "".join(f'<span class="m{i}"><a href="/{i}">{rnd.choice(words)}</a></span> ' for i in range(rnd.randint(4, 8)))
    side = "".join(f'<li><a href="/{i}">{say(2, 4)}</a></li>' for i in range(rnd.randint(3, 6)))
    blocks = [f"<h1>{main[0]}</h1>"] + [f"<p>{t}</p>" for t in main[1:]]
    if rnd.random() < 0.5:
        blocks.insert(rnd.randint(2, len(blocks)), f'<div class="promo-box">{say(4, 9)}</div>')
    return (
        f'<html><body><div id="top"><div class="nav-strip">{menu}</div></div><div id="wrap"><div id="{rnd.choice(("main", "content", "story"))}">{"".join(blocks)}</div>'
        f'<div class="sidebar-right"><ul>{side}</ul></div></div><div class="comments-area"><div class="comment">{say(4, 12)}</div></div><div id="footer">&copy; 2021 {say(2, 5)}</div></body></html>',
        main,
    )


def test_pages_of_another_writer():
    rnd, right, found, wanted = random.Random(3), 0, 0, 0
    for _ in range(120):
        page, main = other_page(rnd)
        got, want = text_of(page).split(), " ".join(main).split()
        keep = set(re.findall(r"\S+", " ".join(main)))
        right += sum(w in keep for w in got)
        found, wanted = found + len(got), wanted + len(want)
    assert right / found > 0.9 and min(found, wanted) / max(found, wanted) > 0.9


def test_article_elements_of_the_table(spark, sf):
    """No label is known, but these pages mark their main text by one element."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    texts = html.extract([p.html for p in pages], html.model())
    same = 0
    for p, t in zip(pages, texts, strict=True):
        m = re.search(r"<article>(.*?)</article>", p.html or "", re.S)
        nodes, _ = html.flatten(html.parse(m[1] if m else ""))
        same += t == "\n".join(n.runs[0] for n in nodes if n.runs)
    assert same >= 0.98 * len(pages)


def test_end_tags_in_any_case():
    body = "The first paragraph of an article has some words, and more of them follow here."
    page = f"<html><body><article><h1>A headline of some words</h1><p>{body}</p><SCRIPT>if (a</b) x()</SCRIPT><p>{body}</p><Style>p {{}}</sTYLE><p>{body}</p></article></body></html>"
    assert text_of(page) == "\n".join(["A headline of some words", body, body, body])
    wide = page.replace("headline", "İheadline")  # a letter whose lower case is longer
    assert text_of(wide) == text_of(page).replace("headline", "İheadline")
    mixed = f"<article><p>{body} <BUTTON>Click me now</button> {body}</p><p>{body} <Svg>x</sVG>{body}</p></article>"
    assert text_of(mixed) == f"{body} {body}\n{body} {body}"
    assert text_of(f"<article><p>{body}</p><p>{body} <scrıpt>y</p></article>").startswith(body)  # not a script


def test_many_open_elements_take_time_in_proportion():
    import time

    def seconds(n):
        page = "<article><p>" + "<svg>a " * n + "</p></article>"
        start = time.perf_counter()
        html.parse(page)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(5_000), 0.005)
    assert len(html.parse("<p>" + "<svg>a " * 20_000 + "</svg></p>").children) == 1
