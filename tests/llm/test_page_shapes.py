"""Shapes of pages that the classifier wasn't trained on: the article between [[ and ]] is wanted, nothing else."""

import re

import pytest

from folioflow.llm.html_extraction import blocks, main_text

P = [
    "The lighthouse keeper climbed the stairs each evening and lit the lamp before the fog came in from the bay.",
    "In winter the supply boat came only once a month, so flour and oil were stored in the cellar.",
    "Ships that passed at night answered with two short flashes.",
    "When the lamp was made electric in 1961, the last keeper moved to the village and opened a small museum.",
]
A = "<h1>Keepers of the lamp</h1>" + "".join(f"<p>{x}</p>" for x in P)
LIST = f"<h2>Parts</h2><p>{P[0]}</p><ul><li>A lens of glass</li><li>A brass frame</li></ul><p>{P[1]}</p>"
MENU = "<nav><a href='/'>Start</a> <a href='/b'>Boats</a> <a href='/c'>Coast</a></nav>"
FOOT = "<footer>&copy; 2020 The Bay. All rights reserved.</footer>"
DISCUSS = "<p>Lovely piece, my uncle was a keeper too.</p><p>The museum is closed on Mondays, by the way.</p>"

SHAPES = {
    "plain article": f"{MENU}[[<article>{A}</article>]]{FOOT}",
    "layout with a sidebar's name": f"<div class='has-sidebar layout'>{MENU}[[<article>{A}</article>]]</div>{FOOT}",
    "article with tags in its names": f"{MENU}[[<article class='post tags'>{A}</article>]]",
    "body says no sidebar": f"<body class='no-sidebar single'>{MENU}[[<article>{A}</article>]]{FOOT}</body>",
    "body says comments open": f"<body class='comments-open nav-fixed'>[[<article>{A}</article>]]{FOOT}</body>",
    "main in a wrapper": f"<div id='page' class='site sidebar-left'>[[<main>{A}</main>]]<aside><ul><li><a href='/x'>Other lamps</a></li></ul></aside></div>",
    "main inside a row": f"{MENU}<div class='row'><div class='col'>[[<main id='main'>{A}</main>]]</div></div>{FOOT}",
    "div with content's name": f"<div id='nav'><a href='/'>Start</a> <a href='/b'>Boats</a></div>[[<div id='content'>{A}</div>]]<div id='footer'>All rights reserved.</div>",
    "entry content": f"<header class='masthead'><a href='/'>The Bay</a></header>[[<div class='entry-content'>{A}</div>]]{FOOT}",
    "unknown class": f"{MENU}[[<div class='zq81'>{A}</div>]]{FOOT}",
    "nested unknown classes": f"<div class='a1'><div class='b2'>{MENU}</div><div class='c3'>[[<div class='d4'>{A}</div>]]</div></div>",
    "no wrapper": f"{MENU}[[{A}]]{FOOT}",
    "old table page": f"<table><tr><td><a href='/'>Start</a><br><a href='/b'>Boats</a></td><td>[[{A}]]</td></tr></table>",
    "comments called respond": f"[[<article>{A}</article>]]<section id='respond'><h3>Have your say</h3>{DISCUSS}</section>",
    "comments by name": f"[[<article>{A}</article>]]<div id='comments'>{DISCUSS}</div>{FOOT}",
    "comments as articles": f"[[<article class='story'>{A}</article>]]<section class='comments'><article class='comment'>{DISCUSS}</article></section>",
    "comments inside the article": f"<article>[[{A}]]<div class='discussion'>{DISCUSS}</div></article>",
    "advert inside": f"<article>[[{A}]]<div class='ad'><p>Lamps at half the price, today only.</p></div></article>{FOOT}",
    "related links inside": f"<article>[[{A}]]<aside><h3>Related</h3><a href='/1'>Boats of the bay</a> <a href='/2'>Fog horns</a></aside></article>",
    "share bar inside": f"<article>[[{A}]]<div class='share-buttons'><a href='/s'>Share</a> <a href='/m'>Mail</a></div></article>",
    "header with the title": f"{MENU}<article>[[<header><h1>Keepers of the lamp</h1></header>{''.join(f'<p>{x}</p>' for x in P)}]]</article>",
    "lists in the text": f"{MENU}[[<article>{LIST}</article>]]{FOOT}",
    "lists in plain divs": f"<div class='menu'><a href='/'>Start</a></div>[[<div class='text'>{LIST}</div>]]{FOOT}",
    "cookie notice first": f"<div class='cookie-consent'><p>This site keeps cookies. Do you agree?</p></div>[[<article>{A}</article>]]",
    "newsletter after": f"[[<article>{A}</article>]]<div class='newsletter'><p>Letters from the bay, once a week. Subscribe now.</p></div>{FOOT}",
    "form after": f"[[<article>{A}</article>]]<form><p>Write to the editor of this page.</p><label>Name</label></form>",
    "breadcrumb before": f"<div class='breadcrumb'><a href='/'>Start</a> / <a href='/c'>Coast</a></div>[[<div class='post'>{A}</div>]]",
    "two articles": f"{MENU}[[<article>{A}</article><article><p>{P[3]}</p><p>{P[2]}</p></article>]]{FOOT}",
    "links in the text": f"{MENU}[[<article><p>{P[0]} See <a href='/l'>the list of lamps</a> for more.</p><p>{P[1]}</p></article>]]",
    "unclosed paragraphs": f"{MENU}[[<article><h1>Keepers</h1>{''.join(f'<p>{x}' for x in P)}</article>]]{FOOT}",
    "hidden menu": f"<div hidden><p>Menu of the site for small screens.</p></div>[[<article>{A}</article>]]",
    "promo category": f"{MENU}[[<article class='post category-promo type-post'>{A}</article>]]{FOOT}",
    "sidebar wrapper holds both": f"<div class='content-sidebar-wrap'>[[<main class='content'>{A}</main>]]<aside class='sidebar'><p>Lamps of the world, a series in six parts.</p></aside></div>",
    "scripts and styles": f"<style>p{{x:y}}</style><script>var a='<p>';</script>{MENU}[[<article>{A}</article>]]<noscript>Turn it on.</noscript>",
    "header in capitals": f"<HEADER><P>THE BAY</P></HEADER>[[<ARTICLE>{A.upper()}</ARTICLE>]]",
    "article of quotes": f"{MENU}[[<article><h1>Voices</h1><blockquote>{P[2]}</blockquote><p>{P[0]}</p><blockquote>{P[1]}</blockquote></article>]]{FOOT}",
}

LINKS = "".join(f"<li><a href='/{k}'>{k} of the coast</a></li>" for k in ("Lamps", "Boats", "Bells", "Fog horns", "Piers"))
THREAD = "".join(f"<li><p>{x}</p></li>" for x in ("Lovely piece, my uncle was a keeper too.", "The museum is closed on Mondays, by the way.", "I went last year and liked it."))

#: Written before the wrappers, roles and short articles were handled.
SHAPES |= {
    "page in a form": f"<form action='/' method='post'>{MENU}[[<div class='content'>{A}</div>]]{FOOT}</form>",
    "page in a form, unknown names": f"<form id='aspnetForm'><div class='w1'>{MENU}</div><div class='w2'>[[{A}]]</div></form>{FOOT}",
    "page in a form with an article": f"<form>{MENU}[[<article>{A}</article>]]</form>",
    "search form beside": f"<form role='search'><p>Search the site</p></form>[[<div class='c9'>{A}</div>]]{FOOT}",
    "one sentence": f"<header><a href='/'>The Bay</a></header>[[<article><p>Closed today.</p></article>]]{FOOT}",
    "one sentence in main": f"{MENU}[[<main><p>No boats until Monday.</p></main>]]{FOOT}",
    "list of links": f"{MENU}[[<article><h1>Links</h1><ul>{LINKS}</ul></article>]]{FOOT}",
    "list of links in main": f"{MENU}[[<main><h1>Index</h1><ol>{LINKS}</ol></main>]]{FOOT}",
    "section with bad names": f"{MENU}[[<section class='tags related-form'>{A}</section>]]{FOOT}",
    "div with bad names": f"{MENU}[[<div class='promo-article'>{A}</div>]]{FOOT}",
    "all in a widget": f"<div class='widget'>{MENU}[[<div class='x1'>{A}</div>]]{FOOT}</div>",
    "all in a modal": f"<div class='modal'><div class='y'>[[{A}]]</div></div>{FOOT}",
    "aside around the article": f"<aside>{MENU}[[<div class='story'>{A}</div>]]</aside>",
    "role main": f"{MENU}[[<div role='main'>{A}</div>]]{FOOT}",
    "role article": f"{MENU}[[<div role='article'>{A}</div>]]{FOOT}",
    "role contentinfo": f"[[<article>{A}</article>]]<div role='contentinfo'><p>The Bay, a paper of the coast since 1890.</p></div>",
    "role navigation": f"<div role='navigation'><p>Start, boats, coast and more</p></div>[[<article>{A}</article>]]",
    "role complementary": f"[[<main>{A}</main>]]<div role='complementary'><p>Lamps of the world, a series in six parts.</p></div>",
    "role banner": f"<div role='banner'><p>The Bay, a paper of the coast.</p></div>[[<div class='post'>{A}</div>]]",
    "role presentation": f"{MENU}[[<div role='presentation' class='k2'>{A}</div>]]{FOOT}",
    "thread of comments": f"[[<article>{A}</article>]]<ul class='thread'>{THREAD}</ul>{FOOT}",
    "comments longer than the article": f"{MENU}[[<article><h1>Keepers</h1><p>{P[0]}</p></article>]]<div class='comments'><h3>Comments</h3>{DISCUSS * 6}</div>{FOOT}",
    "comments longer than a plain article": f"{MENU}[[<div class='post'><h1>Keepers</h1><p>{P[0]}</p><p>{P[1]}</p></div>]]<section id='comments'><h3>Comments</h3>{DISCUSS * 6}</section>",
    "cookie notice longer than the article": f"<div class='cookie-consent'>{''.join(f'<p>We keep cookies of kind {k} to measure how often the pages of this site are read.</p>' for k in range(6))}</div>[[<article><p>{P[0]}</p></article>]]",
}


def both(shape):
    """The page, and the text between its marks."""
    page = SHAPES[shape].replace("[[", "").replace("]]", "")
    inside = re.search(r"\[\[(.*)\]\]", SHAPES[shape], re.S)[1]
    return f"<html><head><title>t</title></head>{page}</html>", " ".join(b.text for b in blocks(inside))


def test_enough_shapes():
    assert len(SHAPES) >= 30


@pytest.mark.parametrize("shape", SHAPES)
def test_shape(shape):
    page, wanted = both(shape)
    assert main_text(page) == wanted


def test_no_name_empties_an_article():
    """Whatever word stands in a name around it, an article isn't lost."""
    from folioflow.llm.html_extraction import BAD_WORDS

    wanted = " ".join(b.text for b in blocks(A))
    for word in sorted(BAD_WORDS):
        for name in (word, f"{word}-layout", f"x-{word}"):
            assert main_text(f"<div class='{name}'>{MENU}<article>{A}</article></div>{FOOT}") == wanted
