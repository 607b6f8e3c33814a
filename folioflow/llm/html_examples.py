"""Pages from which the block classifier is trained, composed by rule from authored fragments.

Elements marked data-keep="1" hold main text, all else is boilerplate. Names of elements are drawn from lists
that mix telling, misleading and meaningless ones, so that no single name decides a label; layouts cover
semantic pages, pages of plain divs, tables, pages without any wrapper, and articles with boilerplate inside.
"""

from __future__ import annotations

from random import Random

_SENTENCES = (
    "The committee met on Tuesday to review the plans, and after a long discussion it agreed to publish the results.",
    "Several members asked for more time, because the figures had changed since the last report was written.",
    "A narrow road leads from the harbour to the old mill, where bread was baked until the flood.",
    "Most of the houses were rebuilt in stone.", "Nobody had expected such a turnout.", "It rained for nine days.",
    "The first machine failed within a week, so the engineers replaced the bearings and tried again.",
    "In the north the harvest was late, while farmers in the south had already sold what they could.",
    "She kept the letters in a tin box under the stairs and never spoke of them.", "Prices rose by four percent.",
    "To build the tool, install the compiler, fetch the sources and follow the steps that are listed below.",
    "The function returns the number of rows that were read, or a negative value if the file is missing.",
    "What began as a small experiment in a school garden has become a network of more than forty gardens.",
    "According to the survey, two thirds of the readers prefer short chapters.", "We walked on in silence.",
)
_SHORT = ("Short end.", "Yes.", "Part two", "x = 1", "Second point", "One more thing", "Table 3", "As follows:")
_LINKS = ("Home", "News", "About us", "Contact", "World", "Sports", "Next", "Privacy", "Log in", "Topics", "Archive", "RSS", "Older posts", "Help centre")
_TEASERS = ("Ten gardens you should see this summer", "Why the bridge had to close again", "The best soups for cold days", "A guide to better sleep", "Five tools we use every day")
_LEGAL = ("&copy; 2021 Example Press. All rights reserved.", "Copyright 2019 &middot; Imprint &middot; Terms of use", "Contact us at the address below.", "Powered by a small engine.")
_ADS = ("Buy one, get one free. Offer ends soon.", "Sign up for our newsletter and never miss a story.", "Save half on your first order when you subscribe today.", "Try it free for thirty days.")
_NOTICES = ("We use cookies to improve this site. By going on you accept them.", "Your browser is out of date.", "Please log in to see all of this page.", "Maintenance is planned for Sunday night.")
_COMMENTS = (
    "Great article, I liked the part about the plans. Thanks for it.", "I do not agree with this at all, and neither does my friend.", "First!",
    "Does anybody know whether this works with the older version as well? I tried and it failed.", "Thanks for sharing, very helpful.",
)
_PLAIN = ("wrap", "row", "x1", "col-8", "block", "css-1q2w3e", "inner", "box", "unit", "area", "level-2", "")
_MISLEADING = ("has-sidebar", "with-nav layout", "page sidebar-right", "no-ads", "site header-fixed", "l-footer-wrapper", "is-menu-open", "container comments-open", "layout-share")
_GOOD_NAMES = ("post-content", "entry-content", "article-body", "story", "main-text", "content", "post", "page-content", "text", "body-copy")
_MIXED = ("post tags", "entry has-comments", "article share-enabled", "content-sidebar", "post type-post category-promo")


class _Maker:
    def __init__(self, seed: int):
        self.r = Random(seed)

    def named(self, *names: str) -> str:
        name = self.r.choice([*names, *_PLAIN[:3]] if self.r.random() < 0.3 else names)
        key = self.r.choice(("class", "class", "id"))
        return f' {key}="{name}"' if name else ""

    def links(self, low: int, high: int, pool: tuple[str, ...] = _LINKS) -> list[str]:
        return [f'<a href="/{i}">{self.r.choice(pool)}</a>' for i in range(self.r.randint(low, high))]

    def listed(self, items: list[str]) -> str:
        form = self.r.randrange(3)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if form == 0 else " ".join(items) if form == 1 else "".join(f"<div>{x}</div>" for x in items)

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(_SENTENCES) for _ in range(self.r.randint(low, high)))

    def element(self, tag: str, names: tuple[str, ...], inside: str) -> str:
        return f"<{tag}{self.named(*names)}>{inside}</{tag}>"

    def navigation(self) -> str:
        return self.element(self.r.choice(("nav", "div", "ul", "nav", "section")), ("nav", "menu", "navbar", "topnav", "breadcrumb", "", "x7"), self.listed(self.links(2, 8)))

    def masthead(self) -> str:
        inside = f'<a href="/">The Paper</a><p>{self.r.choice(("The daily voice of the valley", "News since 1890", "Notes on code"))}</p>'
        return self.element(self.r.choice(("header", "div")), ("header", "masthead", "site-header", "top", "banner"), inside)

    def foot(self) -> str:
        inside = f"<p>{self.r.choice(_LEGAL)}</p>" + self.listed(self.links(0, 4))
        return self.element(self.r.choice(("footer", "footer", "div")), ("footer", "site-footer", "bottom", "copyright", "legal"), inside)

    def advert(self) -> str:
        inside = "".join(f"<p>{x}</p>" for x in self.r.sample(_ADS, self.r.randint(1, 2)))
        if self.r.random() < 0.3:
            inside += f"<p>{self.prose(1, 2)}</p>"
        return self.element(self.r.choice(("div", "section", "aside")), ("ad", "advert", "promo", "sponsored", "newsletter", "banner-ad", "ads"), inside)

    def notice(self) -> str:
        return self.element(self.r.choice(("div", "section")), ("cookie-notice", "notice", "consent", "popup", "modal", "alert"), f"<p>{self.r.choice(_NOTICES)} <a href='/c'>More</a></p>")

    def side(self) -> str:
        inside = "<h3>Related</h3>" + self.listed(self.links(2, 5, _TEASERS)) + (f"<p>{self.prose(1, 1)}</p>" if self.r.random() < 0.4 else "")
        return self.element(self.r.choice(("aside", "aside", "div")), ("sidebar", "related", "widget", "recommended", "side"), inside)

    def comments(self) -> str:
        some = "".join(f"<{t}>{x}</{t}>" for t in [self.r.choice(("p", "li"))] for x in self.r.sample(_COMMENTS, self.r.randint(1, 4)))
        return self.element(self.r.choice(("section", "div", "ol")), ("comments", "respond", "discussion", "disqus_thread", "comment-list", "replies", "responses"), f"<h3>Comments</h3>{some}")

    def form(self) -> str:
        return f"<form><p>{self.r.choice(_ADS)} Enter your name and address to go on.</p><label>Name</label></form>"

    def share(self) -> str:
        return self.element("div", ("share", "social", "share-buttons", "post-tags"), " ".join(self.links(1, 4, ("Share", "Tweet", "Mail", "Print"))))

    def story(self, keep: str, inner: bool) -> str:
        if self.r.random() < 0.2:  # a very short one
            short = self.r.choices(_SHORT + _SENTENCES[3:5], k=self.r.randint(1, 3))
            return "".join(f"<{t}{keep}>{x}</{t}>" for t, x in zip(("h1", "p", "p"), short, strict=False))
        parts = [f"<h1{keep}>{self.r.choice(_TEASERS)}</h1>"] if self.r.random() < 0.8 else []
        if parts and self.r.random() < 0.3:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(self.r.randint(1, 7)):
            form = self.r.random()
            if form < 0.6:
                parts.append(f"<p{keep}>{self.prose(1, 4)}</p>")
            elif form < 0.7:
                parts.append(f"<p{keep}>{self.r.choice(_SHORT)}</p>")
            elif form < 0.78:
                parts.append(f"<h2{keep}>{self.r.choice(_SHORT)}</h2>")
            elif form < 0.86:
                parts.append(f"<ul{keep}>" + "".join(f"<li>{self.r.choice(_SHORT + _SENTENCES)}</li>" for _ in range(self.r.randint(2, 4))) + "</ul>")
            elif form < 0.9:
                parts.append(f"<blockquote{keep}>{self.prose(1, 1)}</blockquote>")
            elif form < 0.94:
                parts.append(f"<pre{keep}>read(x) # {self.r.choice(_SHORT)}</pre>")
            elif form < 0.97:
                parts.append(f"<table{keep}><tr><td>Cell one</td><td>4.2</td></tr></table>")
            else:
                parts.append(f'<p{keep}>See <a href="/x">the report</a> for all of the details of this plan.</p>')
        if inner:
            for make in self.r.sample((self.advert, self.side, self.share, self.form, self.navigation, self.notice, self.foot, self.comments), self.r.randint(1, 3)):
                parts.insert(self.r.randint(1, len(parts)), make())
        return "".join(parts)

    def page(self) -> str:
        kind = self.r.randrange(6)
        keep = ' data-keep="1"'
        body = self.story(keep, inner=self.r.random() < 0.4)
        if kind <= 1:
            body = f"<article{self.named(*_GOOD_NAMES, *_MIXED, '')}>{body}</article>"
        elif kind == 2:
            body = f"<main{self.named('', 'content', *_MISLEADING[:3])}>{body}</main>"
        elif kind == 3:
            body = f"<div{self.named(*_GOOD_NAMES)}>{body}</div>"
        elif kind == 4:
            body = f"<div{self.named(*_PLAIN)}><div>{body}</div></div>"
        for _ in range(self.r.randint(0, 3)):
            body = f"<div{self.named(*_PLAIN, *_MISLEADING)}>{body}</div>"
        before = [m() for m in (self.masthead, self.navigation, self.notice, self.advert) if self.r.random() < 0.5]
        after = [m() for m in (self.comments, self.side, self.share, self.advert, self.navigation, self.foot, self.form) if self.r.random() < 0.45]
        whole = "".join([*before, body, *after])
        if self.r.random() < 0.3:
            whole = f"<div{self.named(*_MISLEADING, *_PLAIN)}>{whole}</div>"
        return f"<html><body{self.named(*_MISLEADING, 'home blog', '')}>{whole}</body></html>"


def pages(n: int = 400, seed: int = 5) -> list[str]:
    """n pages, the same ones each time."""
    return [_Maker(seed * 100_003 + i).page() for i in range(n)]
