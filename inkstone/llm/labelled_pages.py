"""Labelled web pages to train the extractor on: layouts that sites use, filled with invented text, each block with its label.

Nothing here is data of the corpus. Layouts vary in elements (meaningful ones, plain div, tables), in the names of classes and
ids, in what stands on a page and where, and in how cleanly tags are closed; text is invented, so that a field trained on it
learns places and forms and no subject.
"""

import random
from collections.abc import Iterator

LABELS = ("article", "frame", "aside", "comment")
ARTICLE, FRAME, ASIDE, COMMENT = range(4)

# Names that sites give to parts of a page, and short texts found there.
_NAMES = {
    "article": "article post entry story content post-content entry-content article-body articleBody main-content story-body text blog-post page-content hentry body-text",
    "header": "header site-header masthead top topbar page-header banner branding logo",
    "nav": "nav navbar menu navigation main-menu site-nav primary-nav links breadcrumb breadcrumbs toolbar tabs pagination pager",
    "footer": "footer site-footer page-footer bottom colophon copyright footer-links legal",
    "sidebar": "sidebar side aside widget widgets right-column rail secondary related related-posts recommended most-read popular trending teaser more-stories",
    "ad": "ad ads advert advertisement sponsored sponsor promo banner-ad adsbygoogle ad-slot ad-container commercial promotion",
    "notice": "notice cookie cookie-banner consent gdpr alert popup modal overlay newsletter subscribe paywall message announcement warning disclaimer",
    "comments": "comments comment-list commentlist comment-section discussion responses replies disqus comment user-comments reader-comments",
    "form": "search search-form login signup contact-form form subscribe-form",
    "share": "share social sharing share-buttons tags post-meta entry-footer article-tools",
    "plain": "row col wrap wrapper container inner clearfix box section block grid main-wrap layout page",
}
_LINKS = "Home|About|Contact|News|Sport|Products|Services|Blog|FAQ|Help|Careers|Impressum|Kontakt|Startseite|Accueil|À propos|Inicio|Noticias|World|Business|Archive|RSS|Shop|Team|Privacy|Terms|Sitemap"
_CONSENT = "We use cookies to improve your experience.|This site uses cookies.|Accept all cookies|Diese Website verwendet Cookies.|Ce site utilise des cookies.|Este sitio usa cookies.|Privacy settings|Please enable JavaScript.|Subscribe to read on.|You have read your last free article."
_FOOTERS = "© 2021 {}. All rights reserved.|&copy; {} &middot; {}.|Copyright {}|{} · Impressum · Datenschutz|© {} Tous droits réservés|Powered by {}|Terms of use"
_FORMS = "Search|Your email|Sign up|Log in|Password|Submit|Send|Name|Subscribe to our newsletter|Suche|Rechercher|Buscar"
_ADS = "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now|Shop the sale|Try it free"
_SHARES = "Share on Facebook|Tweet|Share|Print|Email this|Tags: {}|Filed under {}|Follow us|Teilen|Partager"
_COMMENTS = "Comments|3 comments|Leave a reply|Reply|12 Kommentare|Commentaires|Comentarios|Discussion|Responses"
_RELATED = "Related articles|Most read|Popular|Read more|More stories|You may also like|Trending|Recent posts|Das könnte Sie interessieren|À lire aussi"
_SYLLABLES = "an en ti ra lo mé ka so ur ble shi nt er ou el pa ver chi zo re üb ña qui da fo gr ist us le mo ten var th ed".split()


class _Page:
    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []
        self.closes = rng.random() < 0.8

    def pick(self, texts: str) -> str:
        return self.rng.choice(texts.split("|")).replace("{}", self.word().title())

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice([1, 1, 2, 2, 3, 4])))

    def words(self, n: int) -> str:
        odd = self.rng.random()
        found = [self.word() for _ in range(n)]
        if odd < 0.12:
            found = [w + self.rng.choice(["###", "$$$", "***", "%%%", "&amp;&amp;", ",", ""]) for w in found]
        elif odd < 0.3:
            found = [self.rng.choice([w, w, w, "&nbsp;" + w, f"{self.rng.randint(1, 2000)}", "&quot;" + w + "&quot;"]) for w in found]
        return " ".join(found)

    def sentences(self, n: int) -> str:
        found = []
        for _ in range(n):
            text = self.words(self.rng.choice([1, 2, 5, 9, 14, 25]))
            found.append(text[:1].upper() + text[1:] + self.rng.choice([".", ".", ".", ".", "?", "!", "...", ""]))
        return " ".join(found)

    def attributes(self, kind: str, chance: float = 0.85) -> str:
        if self.rng.random() > chance:
            kind = "plain"
            if self.rng.random() < 0.5:
                return ""
        names = [self.rng.choice(_NAMES[kind].split())]
        if self.rng.random() < 0.3:
            names.append(self.rng.choice(_NAMES["plain"].split()))
        if self.rng.random() < 0.25:
            names.append(self.word() + "-" + str(self.rng.randint(1, 99)))
        if self.rng.random() < 0.3:
            return f" id={self.rng.choice(names)}"
        return f' class="{" ".join(names)}"'

    def open(self, tag: str, attributes: str = "") -> None:
        self.html.append(f"<{tag}{attributes}>" + self.rng.choice(["", "", "\n", "\n  "]))

    def close(self, tag: str) -> None:
        self.html.append(f"</{tag}>" + self.rng.choice(["", "\n"]))

    def block(self, tag: str, text: str, label: int, attributes: str = "") -> None:
        """An element with text, one leaf block."""
        self.html.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if self.closes or tag not in ("p", "li", "td") else ""))
        self.labels.append(label)

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def link_list(self, label: int, n: int, attributes: str = "", title: bool = False) -> None:
        text = (lambda: self.words(self.rng.randint(3, 10)).capitalize()) if title else (lambda: self.rng.choice([self.pick(_LINKS), self.word(), self.word() + ","]))
        form = self.rng.random()
        if form < 0.7:
            self.open("ul", attributes)
            for _ in range(n):
                self.block("li", self.link(text()), label)
            self.close("ul")
        elif form < 0.85:
            self.block("div", self.rng.choice([" | ", " · ", " "]).join(self.link(text()) for _ in range(n)), label, attributes)
        else:
            self.open("div", attributes)
            for _ in range(n):
                self.block(self.rng.choice(["p", "div", "h4"] if title else ["div", "p"]), self.link(text()), label)
            self.close("div")

    def nav(self) -> None:
        tag = self.rng.choice(["nav", "nav", "div"])
        self.open(tag, self.attributes("nav", 0.5 if tag == "nav" else 1))
        self.link_list(FRAME, self.rng.randint(2, 9))
        self.close(tag)

    def header(self) -> None:
        tag = self.rng.choice(["header", "header", "div"])
        self.open(tag, self.attributes("header", 0.6 if tag == "header" else 1))
        if self.rng.random() < 0.7:
            name = self.words(self.rng.randint(1, 3)).title()
            self.block(self.rng.choice(["div", "p", "h1", "h2"]), self.link(name) if self.rng.random() < 0.6 else name, FRAME)
        if self.rng.random() < 0.3:
            self.block("p", self.sentences(1), FRAME)
        if self.rng.random() < 0.6:
            self.nav()
        if self.rng.random() < 0.3:
            self.form()
        self.close(tag)

    def form(self) -> None:
        self.open("form", self.attributes("form", 0.5))
        for _ in range(self.rng.randint(1, 3)):
            self.block(self.rng.choice(["p", "div", "button"]), self.pick(_FORMS), FRAME)
            self.html.append('<input type="text" name="q">')
        if self.rng.random() < 0.3:
            self.open("select")
            for _ in range(3):
                self.block("option", self.word(), FRAME)
            self.close("select")
        if self.rng.random() < 0.3:
            self.block("p", self.sentences(1), FRAME)
        self.close("form")

    def ad(self) -> None:
        tag = self.rng.choice(["div", "div", "div", "aside", "section", "p"])
        text = self.rng.choice([self.pick(_ADS), self.sentences(1), self.sentences(2), self.sentences(4)])
        if self.rng.random() < 0.7:
            self.block(tag, text, ASIDE, self.attributes("ad", 1))
        else:
            tag = "div" if tag == "p" else tag
            self.open(tag, self.attributes("ad", 1))
            self.block("p", text, ASIDE)
            if self.rng.random() < 0.5:
                self.block("p", self.link(self.pick(_ADS)), ASIDE)
            self.close(tag)

    def notice(self) -> None:
        tag = self.rng.choice(["div", "div", "section", "noscript", "dialog"])
        role = self.rng.choice(["", "", ' role="alert"', ' role="dialog"'])
        self.open(tag, (self.attributes("notice", 1) if tag not in ("noscript", "dialog") else "") + role)
        for _ in range(self.rng.randint(1, 2)):
            self.block(self.rng.choice(["p", "div"]), self.rng.choice([self.pick(_CONSENT), self.sentences(1), self.sentences(2)]), ASIDE)
        if self.rng.random() < 0.5:
            self.block("button", self.pick("OK|Accept|Close|Decline|Subscribe"), ASIDE)
        self.close(tag)

    def sidebar(self) -> None:
        tag = self.rng.choice(["aside", "aside", "div", "section"])
        self.open(tag, self.attributes("sidebar", 0.6 if tag == "aside" else 1))
        for _ in range(self.rng.randint(1, 3)):
            if self.rng.random() < 0.8:
                self.block(self.rng.choice(["h2", "h3", "h4", "p"]), self.rng.choice([self.pick(_RELATED), self.words(2).title()]), ASIDE)
            kind = self.rng.random()
            if kind < 0.5:
                self.link_list(ASIDE, self.rng.randint(2, 6), title=True)
            elif kind < 0.8:
                for _ in range(self.rng.randint(1, 3)):
                    self.block("p", self.sentences(self.rng.randint(1, 4)), ASIDE)
            else:
                self.ad()
        self.close(tag)

    def comments(self) -> None:
        tag = self.rng.choice(["section", "div", "div", "ol"])
        self.open(tag, self.attributes("comments", 1))
        if tag != "ol" and self.rng.random() < 0.7:
            self.block(self.rng.choice(["h2", "h3", "h4"]), self.pick(_COMMENTS), COMMENT)
        item = "li" if tag == "ol" else self.rng.choice(["div", "article", "li", "p"])
        for _ in range(self.rng.randint(1, 5)):
            if item == "p":
                self.block("p", self.sentences(self.rng.randint(1, 4)), COMMENT)
                continue
            self.open(item, self.rng.choice(["", ' class="comment"', ' class="comment-body"', ' class="reply"']))
            if self.rng.random() < 0.6:
                self.block(self.rng.choice(["div", "p", "h4", "footer"]), self.word().title() + self.rng.choice(["", " says:", " · 3 May 2020", " wrote"]), COMMENT)
            for _ in range(self.rng.randint(1, 2)):
                self.block(self.rng.choice(["p", "div"]), self.sentences(self.rng.randint(1, 5)), COMMENT)
            if self.rng.random() < 0.5:
                self.block("div", self.link("Reply"), COMMENT)
            self.html.append(f"</{item}>")
        if tag != "ol" and self.rng.random() < 0.3:
            self.open("form")
            self.block("p", self.pick(_COMMENTS), FRAME)
            self.close("form")
        self.close(tag)

    def footer(self) -> None:
        tag = self.rng.choice(["footer", "footer", "div"])
        attributes = self.attributes("footer", 0.5 if tag == "footer" else 1)
        if self.rng.random() < 0.5:
            self.block(tag, self.pick(_FOOTERS) + " " + self.rng.choice(["", self.sentences(1)]), FRAME, attributes)
            return
        self.open(tag, attributes)
        if self.rng.random() < 0.6:
            self.link_list(FRAME, self.rng.randint(2, 6))
        self.block(self.rng.choice(["p", "div"]), self.pick(_FOOTERS), FRAME)
        if self.rng.random() < 0.3:
            self.block("p", self.sentences(self.rng.randint(1, 3)), FRAME)
        self.close(tag)

    def share(self) -> None:
        tag = self.rng.choice(["div", "div", "footer", "ul"])
        self.open(tag, self.attributes("share", 1 if tag != "footer" else 0.5))
        for _ in range(self.rng.randint(1, 4)):
            text = self.pick(_SHARES)
            self.block("li" if tag == "ul" else self.rng.choice(["p", "div"]), self.link(text) if self.rng.random() < 0.6 else text, FRAME)
        self.close(tag)

    def rich(self, n: int) -> str:
        """Sentences, some words marked or linked."""
        found = []
        for _ in range(n):
            text = self.sentences(1)
            kind = self.rng.random()
            tag = self.rng.choice(["b", "i", "em", "strong", "span", "code"])
            found.append(self.link(text) if kind < 0.08 else f"<{tag}>{text}</{tag}>" if kind < 0.25 else text)
        return self.rng.choice([" ", " ", "<br>", "\n"]).join(found)

    def text_part(self) -> None:
        kind = self.rng.random()
        if kind < 0.66:
            self.block("p", self.rich(self.rng.choice([1, 1, 2, 4, 8])), ARTICLE, self.rng.choice(["", "", "", ' class="lead"', f' class="{self.word()}"']))
        elif kind < 0.74:
            self.block(self.rng.choice(["h2", "h3", "h4"]), self.words(self.rng.randint(1, 8)).capitalize(), ARTICLE)
        elif kind < 0.79:
            tag = self.rng.choice(["ul", "ol"])
            self.open(tag)
            for _ in range(self.rng.randint(1, 5)):
                self.block("li", self.rich(1), ARTICLE)
            self.close(tag)
        elif kind < 0.83:
            self.open("blockquote")
            self.block("p", self.sentences(2), ARTICLE)
            self.close("blockquote")
        elif kind < 0.87:
            self.open("figure")
            self.html.append('<img src="a.png" alt="x">')
            self.block("figcaption", self.sentences(1), ARTICLE)
            self.close("figure")
        elif kind < 0.91:
            self.open("table")
            for _ in range(self.rng.randint(1, 3)):
                self.html.append("<tr>")
                for _ in range(self.rng.randint(1, 3)):
                    self.block(self.rng.choice(["td", "td", "th"]), self.rng.choice([self.words(2), str(self.rng.randint(0, 999))]), ARTICLE)
                self.html.append("</tr>")
            self.close("table")
        elif kind < 0.94:
            self.block(self.rng.choice(["pre", "div", "section"]), self.sentences(3), ARTICLE)
        else:
            # a paragraph whose bold text is never closed
            self.html.append(f"<p><b>{self.sentences(self.rng.choice([1, 2]))}<br>")
            self.labels.append(ARTICLE)

    def article(self) -> None:
        kind = self.rng.random()
        tags = ["article"] if kind < 0.35 else ["main", "article"] if kind < 0.5 else ["main"] if kind < 0.6 else ["div"] if kind < 0.85 else ["section"] if kind < 0.9 else ["div", "div"]
        opened = []
        for tag in tags:
            self.open(tag, self.attributes("article", 0.4 if tag in ("article", "main") else 1))
            opened.append(tag)
        if self.rng.random() < 0.9:
            own = self.rng.random() < 0.15
            if own:
                self.open("header")
            self.block("h1", self.words(self.rng.randint(1, 12)).capitalize(), ARTICLE)
            if own:
                self.close("header")
        extras = [f for f in (self.ad, self.share, self.form, self.notice, self.sidebar) if self.rng.random() < 0.1]
        parts = self.rng.choice([1, 3, 6, 10, 16, 30])
        at = {self.rng.randint(1, parts): f for f in extras}
        for i in range(1, parts + 1):
            self.text_part()
            if i in at:
                self.html.append("</p>")
                at[i]()
        self.html.append("</p>")
        if self.rng.random() < 0.15:
            self.share()
        if self.rng.random() < 0.12:
            self.comments()
        for tag in reversed(opened):
            self.close(tag)


def _page(rng: random.Random) -> tuple[str, list[int]]:
    p = _Page(rng)
    p.html.append("<!DOCTYPE html><html><head><title>x</title><style>p{margin:0}</style><script>var t='</p>';</script></head>")
    p.open("body", p.attributes("plain", 0.5))
    wrapped = rng.random() < 0.4
    if wrapped:
        p.open("div", p.attributes("plain", 1))
    may = lambda part, chance: part() if rng.random() < chance else None
    may(p.notice, 0.2)
    may(p.header, 0.5)
    may(p.nav, 0.6)
    may(p.ad, 0.35)
    may(p.form, 0.1)
    may(p.sidebar, 0.2)
    p.article()
    may(p.ad, 0.15)
    may(p.share, 0.1)
    may(p.comments, 0.3)
    may(p.sidebar, 0.3)
    may(p.notice, 0.1)
    may(p.footer, 0.8)
    may(p.notice, 0.1)
    if wrapped:
        p.close("div")
    if rng.random() < 0.8:
        p.html.append("</body></html>")
    return "".join(p.html), p.labels


def labelled_pages(n: int, seed: int) -> Iterator[tuple[str, list[int]]]:
    """n pages and the labels of their blocks, in page order."""
    rng = random.Random(seed)
    for _ in range(n):
        yield _page(rng)
