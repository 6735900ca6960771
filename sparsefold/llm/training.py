"""Made-up web pages with known states, on which the main-text model is trained.

A page is drawn from a small grammar of layouts: wrappers around an article under various tags and class names, menus,
headers, footers, sidebars, notices, adverts, forms and reader comments around and inside it. Half of the pages and a share
of the blocks of the others have no telling names: none at all or made-up ones, and layouts of plain blocks or tables, so
that density, links and neighbours have to tell. Every block element carries its state in an attribute data-state, which no
feature reads. The same seed gives the same pages.
"""

from __future__ import annotations

import random

SYLLABLES = "an be co da er fi go ha in ju ka le mo na or pa qui re sa ti un ve wo xe ya zu ber chen tion ment ing est".split()
MAIN = (("article", ""), ("article", "post"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "article-body"), ("div", "post entry"), ("section", "story"), ("div", "main-text"), ("div", ""), ("div", "c7 x1"), ("section", ""), ("td", "text"), ("div", "entry-content"))
CHROME = (("nav", ""), ("nav", "main-nav"), ("header", ""), ("header", "site-header"), ("footer", ""), ("footer", "site-footer"), ("aside", ""), ("aside", "sidebar"), ("div", "ad"), ("div", "advert banner"), ("div", "cookie-notice"), ("div", "sidebar"), ("div", "menu"), ("div", "footer"), ("div", "header top"), ("form", ""), ("form", "search"), ("div", "related"), ("section", "comments"), ("div", "comment-list"), ("ul", "menu"), ("div", "share social"), ("div", "newsletter"), ("div", "notice"), ("p", "copyright"), ("div", "breadcrumb"), ("section", "related-posts"), ("div", "popup modal"), ("ol", "comments"), ("div", "promo"), ("div", "widget"))
INNER = (("div", "ad"), ("aside", ""), ("aside", "related"), ("div", "share"), ("form", "newsletter"), ("div", "advert"), ("nav", "toc"), ("div", "promo"), ("div", "comments"), ("section", "comments"), ("div", "sponsored"), ("div", "notice"), ("footer", ""), ("p", "ad"))


class _Pages:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def words(self, n: int) -> str:
        found = [self.word() + self.r.choice(("", "", "", "", "", "", ",", ".")) for _ in range(n)]
        if self.r.random() < 0.08:
            found = [w + self.r.choice(("***", "$$$", "&amp;&amp;", "!!", " |")) for w in found]
        return " ".join(found).capitalize()

    def tag(self, name: str, classes: str, state: str, inside: str) -> str:
        key = self.r.choice(("class", "class", "class", "id"))
        named = f' {key}="{classes}"' if classes else ""
        return f'<{name}{named} data-state="{state}">{inside}</{name}>'

    def sentence(self, low: int, high: int) -> str:
        return self.words(self.r.randint(low, high)) + self.r.choice((".", ".", ".", ""))

    def paragraph(self, state: str) -> str:
        r = self.r
        text = self.sentence(*r.choice(((1, 6), (8, 40), (8, 40), (30, 200), (30, 120))))
        if r.random() < 0.15:  # such words are found in main texts, too
            text += " " + r.choice(("says", "the reply", "cookies", "a newsletter", "12 comments", "privacy", "they accept", "to subscribe")) + " " + self.sentence(1, 12)
        kind = r.random()
        if kind < 0.1:
            text = f"<b>{text}<br>"
            return f'<p data-state="{state}">{text}'  # left open, as many pages do
        if kind < 0.2:
            text = text.replace(" ", ' <a href="/x">link</a> ', 1)
        if kind < 0.25:
            return self.tag(r.choice(("blockquote", "pre")), "", state, text)
        if kind < 0.3:
            return self.tag(r.choice(("ul", "ol")), "", state, "".join(self.tag("li", "", state, self.sentence(3, 25)) for _ in range(r.randint(2, 6))))
        if kind < 0.33:
            return self.tag("div", "", state, text)
        if kind < 0.36:
            return self.tag("figure", "", state, self.tag("figcaption", "", state, self.sentence(4, 15)))
        if kind < 0.39:
            cell = lambda: self.tag("td", "", state, self.sentence(1, 4))
            return self.tag("table", "", state, "".join(self.tag("tr", "", state, cell() + cell()) for _ in range(r.randint(2, 5))))
        return self.tag("p", "", state, text)

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.sentence(1, 3)}</a>' for _ in range(self.r.randint(3, 10))]
        listed = "".join(self.tag("li", "", "out", i) for i in items)
        return self.r.choice((self.tag("ul", "", "out", listed), " | ".join(items), self.tag("div", "", "out", " ".join(items))))

    def off(self, name: str, classes: str) -> str:
        """A block that is no main text."""
        r = self.r
        if name in ("ul", "ol") and classes == "menu" or name == "nav":
            inside = r.choice((self.links(), self.links(), self.links(), self.sentence(1, 6))) if name == "nav" else "".join(self.tag("li", "", "out", f'<a href="/x">{self.sentence(1, 3)}</a>') for _ in range(r.randint(3, 9)))
        elif "comment" in classes:
            inside = self.tag("h3", "", "out", "Comments") * r.randint(0, 1) + "".join(self.tag(r.choice(("div", "li", "article")), r.choice(("comment", "", "reply")), "out", self.tag("p", r.choice(("", "author")), "out", self.sentence(2, 5)) * r.randint(0, 1) + self.tag("p", "", "out", self.sentence(5, 60))) for _ in range(r.randint(1, 5)))
        elif name == "form":
            inside = f"<label>{self.sentence(1, 4)}</label><input name=q><button>{self.word()}</button>" + self.tag("p", "", "out", self.sentence(3, 15)) * r.randint(0, 1)
        elif name == "p":
            inside = "&copy; " * (classes == "copyright") + self.sentence(3, 15)
        else:
            inside = r.choice((self.sentence(4, 20), self.sentence(4, 40), self.tag("p", "", "out", self.sentence(4, 40)), self.links(), self.tag("h2", "", "out", self.sentence(1, 4)) + self.links(), f"&copy; {self.word()} &middot; {self.sentence(3, 15)}", self.tag("h1", "", "out", self.sentence(1, 4)) + self.sentence(2, 8)))
        return self.tag(name, classes, "out", inside)

    def made_up(self) -> str:
        """A class name that says nothing, or none."""
        r = self.r
        return r.choice(("", "", "", f"css-{r.randint(10, 9999)}", f"sc-{self.word()}{r.randint(1, 99)}", f"c{r.randint(1, 30)} x{r.randint(1, 9)}", f"_{self.word()}", f"u{r.randint(100, 999)}"))

    def link(self, low: int = 1, high: int = 3) -> str:
        return f'<a href="/{self.word()}">{self.sentence(low, high)}</a>'

    def plain_off(self, edge: bool = True) -> str:
        """A block that is no main text, by its content alone; edge: it is at the page's start or end."""
        r, out = self.r, "out"
        listed = lambda low, high: self.tag(r.choice(("ul", "ul", "ol")), self.made_up(), out, "".join(self.tag("li", "", out, self.link(1, r.choice((2, 6)))) for _ in range(r.randint(low, high))))
        joined = lambda low, high: r.choice((" | ", " &middot; ", " ", " / ", "<br>", "")).join(self.link() for _ in range(r.randint(low, high)))
        small = r.choice(("div", "div", "p", "section"))
        kinds = [
            lambda: self.tag("div", self.made_up(), out, listed(3, 9)),
            lambda: listed(3, 9),
            lambda: self.tag(small, self.made_up(), out, joined(2, 9)),
            lambda: self.tag("div", self.made_up(), out, "".join(self.tag("div", self.made_up(), out, self.link()) for _ in range(r.randint(2, 8)))),
            lambda: self.tag("div", self.made_up(), out, self.tag(r.choice(("h2", "h3", "h4", "p")), "", out, self.sentence(1, 3)) + listed(2, 8)),
            lambda: self.tag("div", self.made_up(), out, self.tag("div", self.made_up(), out, self.tag(r.choice(("h3", "h4")), "", out, self.sentence(1, 2)) + listed(2, 5)) * r.randint(1, 3)),
            lambda: self.tag("div", self.made_up(), out, "<label>" + self.sentence(1, 3) + "</label><input name=q><button>Go</button>"),
            lambda: self.tag(small, self.made_up(), out, self.link() + r.choice((" &gt; ", " &raquo; ", " / ")) + self.link() + r.choice((" &gt; ", " &raquo; ")) + self.words(r.randint(1, 4))),
        ]
        kinds += [self.remarks, self.request]
        if edge:
            kinds += [
                lambda: self.tag(small, self.made_up(), out, r.choice(("&copy; ", "Copyright ", "&copy; 20%02d " % r.randint(0, 30))) + self.sentence(1, 8)),
                lambda: self.tag(small, self.made_up(), out, r.choice((" | ", " - ", " &middot; ")).join(self.words(r.randint(1, 2)) for _ in range(r.randint(2, 5)))),
                lambda: self.tag("div", self.made_up(), out, self.tag("p", "", out, joined(2, 5)) + self.tag("p", "", out, "&copy; " + self.sentence(1, 6))),
            ]
        return r.choice(kinds)()

    def remarks(self) -> str:
        """Reader comments without telling names: a heading with their number, then names, texts, dates and links to reply."""
        r, out = self.r, "out"
        name = lambda: self.word().capitalize() + (" " + self.word().capitalize()) * r.randint(0, 1)
        heading = r.choice((f"{r.randint(1, 90)} comments", f"{r.randint(2, 40)} Responses", "Comments", "Comments:", f"{r.randint(2, 30)} Replies", f"{r.randint(2, 9)} thoughts on this"))
        style = r.choice(("says", "line", "bold", "plain"))

        def one() -> str:
            who, text = name(), self.sentence(3, 50)
            intro = {"says": f"{who} {r.choice(('says', 'says:', 'wrote:', 'replied'))}", "line": f"{who}, {r.randint(1, 28)} {self.word()} 20{r.randint(10, 30)}", "bold": f"<b>{who}</b>", "plain": who}[style]
            parts = r.choice((self.tag("p", "", out, intro) + self.tag("p", "", out, text), f"{intro} {text}", self.tag("div", self.made_up(), out, intro) + self.tag("div", self.made_up(), out, text), f"<b>{who}</b> {r.choice(('says', 'wrote'))}: {text}"))
            return self.tag(r.choice(("div", "div", "li", "p" if "<" not in parts else "div")), self.made_up(), out, parts + r.choice(("", "", ' <a href="#r">Reply</a>')))

        inside = (self.tag(r.choice(("h2", "h3", "h3", "h4", "p")), "", out, heading) if r.random() < 0.85 else "") + "".join(one() for _ in range(r.randint(1, 6)))
        if r.random() < 0.3:
            inside += self.tag("h3", "", out, r.choice(("Leave a reply", "Leave a comment", "Log in to reply"))) + "<textarea></textarea><button>Send</button>"
        return self.tag(r.choice(("div", "div", "section")), self.made_up(), out, inside)

    def request(self) -> str:
        """A notice or a sign-up box without telling names."""
        r, out = self.r, "out"
        says = r.choice(("We use cookies to ", "This site uses cookies. ", "By going on you consent to ", "Your privacy matters. ", "Subscribe to our newsletter ", "Sign up for ", "Accept notifications from ", "Get the newsletter: ")) + self.sentence(2, 30)
        button = r.choice((f"<button>{self.word()}</button>", f"<button>{self.word()}</button><button>OK</button>", '<input type="submit" value="OK">', '<a href="#">OK</a>', ""))
        inside = r.choice((says, self.tag("p", "", out, says), self.tag("span", "", out, says))) + button
        if r.random() < 0.2:
            inside = self.tag(r.choice(("h3", "h4")), "", out, self.sentence(1, 4)) + inside
        return self.tag(r.choice(("div", "div", "section", "p" if "<p" not in inside and "<h" not in inside else "div")), self.made_up(), out, inside)

    def article(self, plain: bool = False) -> str:
        r = self.r
        boxed = r.random() < 0.2  # headings in wrappers of their own, paragraphs as plain blocks with made-up names
        hashed = f"p{r.randint(1, 999)}" if r.random() < 0.7 else ""

        def head(name: str, classes: str, low: int, high: int) -> str:
            found = self.tag(name, classes, "in", self.sentence(low, high))
            return self.tag("div", self.made_up(), "in", found) if boxed and r.random() < 0.8 else found

        name, classes = r.choice(MAIN)
        if plain:
            name, classes = r.choice((("div", ""), ("div", self.made_up()), ("section", self.made_up()), ("td", ""), ("td", self.made_up()), ("main", ""), ("article", "")))
        parts = [self.tag("div", hashed, "in", self.sentence(8, 120)) if boxed and r.random() < 0.8 else self.paragraph("in") for _ in range(r.choice((1, 2, 3, 5, 8, 14)))]
        if r.random() < 0.85:
            parts.insert(0, head(r.choice(("h1", "h1", "h1", "h2")), r.choice(("", "", "title")), 2, 12))
        for _ in range(r.randint(0, 3)):
            if len(parts) > 2:
                parts.insert(r.randrange(1, len(parts)), head(r.choice(("h2", "h3")), "", 1, 6))
        for _ in range(r.choice((0, 0, 1, 2))):
            parts.insert(r.randrange(1, len(parts) + 1), self.plain_off(edge=False) if plain and r.random() < 0.7 else self.off(*r.choice(INNER)))
        inside = "".join(parts)
        if r.random() < 0.3:
            inside = self.tag(r.choice(("div", "section")), r.choice(("", "body", "text")) if not plain else self.made_up(), "in", inside)
        if name == "td":
            aside = lambda: self.tag("td", self.made_up(), "out", self.plain_off()) if plain else ""
            left, right = (aside() if r.random() < 0.6 else "" for _ in range(2))
            row = self.tag("tr", "", "mixed", left + self.tag("td", classes, "in", inside) + right)
            above = self.tag("tr", "", "out", self.tag("td", "", "out", self.plain_off())) if plain and r.random() < 0.3 else ""
            return self.tag("table", "", "mixed", above + row)
        return self.tag(name, classes, "in", inside)

    def page(self) -> str:
        r = self.r
        plain = r.random() < 0.5
        chrome = lambda: self.plain_off() if r.random() < (0.9 if plain else 0.2) else self.off(*r.choice(CHROME))
        main = self.article(plain)
        for _ in range(r.choice((0, 0, 1, 1, 2))):  # wrappers, some with chrome beside the article
            beside = "".join(chrome() for _ in range(r.choice((0, 1, 2))))
            named = self.made_up() if plain else r.choice(("", "", "wrap", "container", "page", "main", "row c2"))
            main = self.tag(r.choice(("div", "div", "section", "main")), named, "mixed", r.choice((main + beside, beside + main)))
        before = [chrome() for _ in range(r.choice((0, 1, 2, 3)))]
        after = [chrome() for _ in range(r.choice((0, 1, 2, 3)))]
        if not plain:
            if r.random() < 0.6:
                before.insert(0, self.off(*r.choice((("nav", ""), ("nav", "menu"), ("header", "")))))
            if r.random() < 0.7:
                after.append(self.off("footer", r.choice(("", "footer"))))
        if plain or r.random() < 0.2:
            after.append(self.tag(r.choice(("div", "p")), "", "out", r.choice(("&copy; ", "Copyright ", "Copyright &copy; ")) + self.sentence(1, 8)))
        body = "".join([*before, main, *after])
        whole = f'<!DOCTYPE html><html lang="en" data-state="mixed"><head><title>{self.sentence(2, 6)}</title><style>p{{margin:0}}</style></head><body data-state="mixed">{body}</body></html>'
        if r.random() < 0.1:
            whole = whole[: r.randint(len(whole) * 2 // 3, len(whole))]
        return whole


def labelled_pages(count: int, seed: int) -> list[str]:
    """count pages; now and then one is a bare text or a list of paragraphs without a wrapper, instead of a page of the grammar."""
    pages = _Pages(seed)
    out = []
    for i in range(count):
        if i % 40 == 1:
            text = "<br>".join(pages.sentence(3, 120) for _ in range(1 + i % 3))
            out.append(text if i % 80 == 1 else f'<html data-state="mixed"><body data-state="in">{text}</body></html>')
        elif i % 40 == 0:
            body = "".join(pages.paragraph("in") for _ in range(1 + i % 7))
            out.append(f'<html data-state="mixed"><body data-state="mixed">{body}</body></html>')
        else:
            out.append(pages.page())
    return out
