"""Pages with several articles, raw elements, formulas and labels, and junk under names that the operator does not list."""

import pytest

from glyphtally.llm.html_main import main_text

TEXT = "It was told, at length, that the river rose, fell, and rose again, before anyone, even the miller, had noticed what was going on. "
LONG, OTHER = TEXT * 3, TEXT.replace("river", "road") * 3


def lines(*parts):
    return "\n\n".join(" ".join(p.split()) for p in parts)


def test_articles_beside_each_other():
    card = "<article class=card><p>Read on, now.</p></article>"
    assert main_text(f"<body><nav>menu</nav><div><article><p>{LONG}</p></article><article><p>{OTHER}</p><p>{OTHER}</p></article>{card}</div><footer>f</footer></body>") == lines(LONG, OTHER, OTHER)


def test_articles_inside_articles():
    inner = f"<article class=card><p>{OTHER}</p><p>{OTHER}</p><p>{OTHER}</p></article>"
    assert main_text(f"<body><article><h1>Title</h1><p>{LONG}</p>{inner}<p>End, of it.</p></article></body>") == lines("Title", LONG, OTHER, OTHER, OTHER, "End, of it.")
    assert main_text(f"<body><article>{inner}</article></body>") == lines(OTHER, OTHER, OTHER)


@pytest.mark.parametrize("raw", ["<script src=a.js/>var leaked=1;</script>", "<style media=all />p { leaked: 1 }</style>", "<script>if (a</b) leaked()</script>", "<svg/>", "<script src='a.js' />"])
def test_raw_elements_end_at_their_end_tag(raw):
    assert main_text(f"<article>{raw}<p>{LONG}</p></article>") == lines(LONG)


def test_formulas_and_labels():
    page = "<article><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math>, the <label>Name</label> is, so to say, given.</p></article>"
    assert main_text(page) == "Where x=2, the Name is, so to say, given."
    assert main_text(f"<body><label for=menu>Menu</label><article><p>{LONG}</p></article><label>Search</label></body>") == lines(LONG)


@pytest.mark.parametrize("name", ["responses", "discussion-thread", "ad-unit-300x250", "google-ad", "related-articles", "discussion", "promoted-stories", "taboola"])
def test_threads_and_adverts(name):
    junk = f"<div class='{name}'><p>Buy, this, now, it is, really, the best</p></div>"
    for tag in ("article", "div"):
        assert main_text(f"<body><{tag} class=text><p>{LONG}</p><p>{OTHER}</p>{junk}</{tag}></body>") == lines(LONG, OTHER)


@pytest.mark.parametrize("name", ["article", "article-body", "articles-of-faith", "google-earth", "road-unit", "response-time", "thread-count"])
def test_names_that_only_sound_alike(name):
    assert main_text(f"<body><article><p>{LONG}</p><div class='{name}'><p>{OTHER}</p></div></article></body>") == lines(LONG, OTHER)


@pytest.mark.parametrize("piece", ["<article><p>a, b", "<script/>", "<article>", "</article><label>x"])
def test_time_grows_with_length(piece):
    main_text(piece * (200_000 // len(piece)))
