"""Main containers against trying every one of them."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.functions import maincontent as mc


def grams(text):
    return {text[k : k + mc.GRAM] for k in range(len(text) - mc.GRAM + 1)} if len(text) >= mc.GRAM else {text} - {""}


def tried(page, target):
    """Level, text and grams of the main container, every container by itself."""
    want = grams(target)
    best = None
    for c in page.containers[1:]:
        text = page.text[c.begin : c.end]
        if c.noise or not c.structure or len(text) < int(len(target) / 2) or not want or len(want & grams(text)) / len(want) < 0.6:
            continue
        if best is None or len(text) < len(best):
            best = text
    return best


def check(source, target=None):
    page, own = mc.read_page(source)
    target = own if target is None else target
    got, best = mc.locate(page, target), tried(page, target)
    assert mc.contained(page, target) == [len(grams(target) & grams(page.text[c.begin : c.end])) for c in page.containers]
    assert (got.level == "matched") == (best is not None)
    if best is not None:
        assert page.text[got.begin : got.end] == best


@pytest.mark.parametrize("table", ["sf0.001"])
def test_all_pages(spark, table):
    rows = spark.read.parquet(f"/root/testdata/{table}/pages.parquet").collect()
    for r in rows:
        check(r.html)
    levels = {mc.locate(*mc.read_page(r.html)).level for r in rows}
    assert "matched" in levels


@settings(max_examples=200, deadline=None)
@given(st.randoms(use_true_random=False))
def test_nested_containers_with_repeats(rng):
    pieces = ["abcdefghijklmnop", "abcdefghijklmnopqrstuv", "0123456789012345", "xyz", "the same line again and again"]

    def tree(depth):
        out = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.choice(["div", "section", "p", "text", "article", "noise"]) if depth < 5 else "text"
            if kind == "text":
                out.append(rng.choice(pieces) + " ")
            elif kind == "p":
                out.append(f"<p>{rng.choice(pieces)}{rng.choice(pieces)}" + rng.choice(["</p>", ""]))
            else:
                tag, name = ("div", ' class="page-footer"') if kind == "noise" else (kind, "")
                out.append(f"<{tag}{name}>{tree(depth + 1)}</{tag}>")
        return "".join(out)

    source = f"<body>{tree(0)}</body>"
    check(source)
    check(source, "".join(rng.choice(pieces).replace(" ", "") for _ in range(rng.randint(0, 3))))


def test_inner_container_wins_and_noise_never_does():
    words = " ".join(f"word{k} stands here" for k in range(40))
    page, target = mc.read_page(f"<body><div id=outer><nav><a href=x>menu entry</a></nav><div><p>{words}</p></div><div class=reflist><p>{words}</p></div></div></body>")
    at = mc.locate(page, target)
    assert at.level == "matched" and page.text[at.begin : at.end] == words.replace(" ", "") and at.grams == at.wanted - 7  # the seam between both copies
    assert mc.locate(*mc.read_page("<main>few</main>")).level == "semantic_container"
    assert mc.locate(*mc.read_page("plain")).level == "full_body" and mc.locate(*mc.read_page(None)).level == "full_body"
    hidden, _ = mc.read_page("<div hidden><p>a</p></div><div aria-hidden=true>b</div><script>c</script><!-- d --><p>e<p>f<svg><p>g</p></svg>")
    assert hidden.text == "ef"


def test_long_pages_stay_linear():
    rng = random.Random(1)
    source = "<div>" * 200 + "".join(f"<section><p>{rng.random()} {'same words here ' * 8}</p></section>" for _ in range(1500)) + "</div>" * 200
    page, target = mc.read_page(source)
    assert mc.locate(page, target).level == "matched" and len(page.text) > 150_000
