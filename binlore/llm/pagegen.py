"""Invented web pages with known main text, to train and measure the block labeller.

A page is a list of (markup, text, is_main) pieces in page order, made from a seed. Words are invented; layouts vary in
tags, class names, nesting, order, unclosed elements and noise, so that no single cue decides.
"""

from __future__ import annotations

import html
import random

#: Class and id words by region; labels come from the region, never from the word alone.
MAIN = "article content post entry story main body text article-body post-content entry-content main-content page-content story-body prose markdown".split()
NOISE = {
    "nav": "nav menu navbar navigation topnav breadcrumb breadcrumbs main-menu site-nav pagination tabs".split(),
    "header": "header masthead top site-header topbar branding logo banner-top page-head".split(),
    "footer": "footer bottom site-footer colophon copyright legal footer-links page-foot".split(),
    "aside": "sidebar aside widget related recommended trending popular side rail right-col tags more-stories".split(),
    "notice": "notice cookie cookie-banner gdpr consent alert warning paywall overlay modal popup announcement cookie-notice message".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion banner adsense ad-slot sponsor".split(),
    "form": "form newsletter subscribe signup login search search-form contact-form subscription".split(),
    "comments": "comments comment comment-list reply replies discussion responses disqus feedback user-comments thread".split(),
    "social": "share social share-buttons follow social-links byline-social".split(),
}
PHRASES = {
    "nav": ["Home", "About", "Contact", "News", "Products", "Blog", "Next page", "Archive", "Accueil", "Inicio", "Startseite"],
    "header": ["Welcome to our site", "Daily news", "Skip to content", "Menu", "Log in", "Your source for news"],
    "footer": ["© 2024 All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Powered by", "&copy; example.com &middot;", "Contact us"],
    "aside": ["Related articles", "Most read", "You may also like", "Recent posts", "Tags", "Read more", "Popular this week"],
    "notice": ["We use cookies to improve your experience.", "Accept all", "By continuing you agree to our terms.", "Please enable JavaScript.", "This site uses cookies. OK", "Subscribe to continue reading."],
    "ad": ["Advertisement", "Sponsored", "Buy now and save 50%!", "Limited offer", "Click here", "Ad"],
    "form": ["Your e-mail", "Sign up for our newsletter", "Submit", "Name", "Password", "Search", "Subscribe now"],
    "comments": ["Comments", "3 comments", "Reply", "Leave a comment", "says:", "Great article, thanks!", "Log in to comment", "I disagree with this."],
    "social": ["Share on", "Tweet", "Follow us", "Like", "Share this"],
}
_TAGS = {"nav": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "div"], "aside": ["aside", "div", "section"], "notice": ["div", "section", "aside", "p", "dialog"],
         "ad": ["div", "aside", "section", "p"], "form": ["form", "div"], "comments": ["section", "div", "ol"], "social": ["div", "ul"]}


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        parts = [self.r.choice("bcdfghjklmnprstvwz") + self.r.choice("aeiouyäöüéèêçñó") + self.r.choice(("", "", "n", "r", "st", "ng")) for _ in range(30)]
        self.syllables = [*parts, *(x[1:] for x in parts[:15])]
        self.out: list[str] = []
        self.main: list[str] = []
        self.named = self.r.random() < 0.85  # pages without telling names exist too
        self.semantic = self.r.random() < 0.75
        self.junk = self.r.choice(("", "", "", "", "", " | ", "### ", "&&& ", " * ", " 7 ", " @ ", " - ", ", ", " ")) or None

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3, 4))))

    def sentence(self, n: int | None = None) -> str:
        words = [self.word() for _ in range(n or self.r.randint(1, 18))]
        for k in range(len(words) - 1):
            if self.r.random() < 0.06:
                words[k] += ","
        return " ".join(words).capitalize() + self.r.choice(("." if self.r.random() < 0.95 else "", "!", "?", ".", ".", "."))

    def prose(self) -> str:
        if self.junk and self.r.random() < 0.7:  # lists of words, symbols and numbers are main text too
            if self.r.random() < 0.3:
                return self.junk.join([self.word()] * self.r.randint(2, 60))
            return self.junk.join(self.word() for _ in range(self.r.randint(2, 60)))
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))

    def marked(self, text: str) -> str:
        """Escaped text with inline markup and odd white space."""
        words = [html.escape(w, quote=self.r.random() < 0.5) for w in text.split(" ")]
        for k in range(len(words)):
            x = self.r.random()
            if x < 0.02:
                words[k] = f"<{(t := self.r.choice(('b', 'i', 'em', 'strong', 'span', 'code')))}>{words[k]}</{t}>"
            elif x < 0.035:
                words[k] = f'<a href="/{self.r.randint(1, 99)}">{words[k]}</a>'
        return self.r.choice((" ", " ", " ", "\n", "  ")).join(words)

    def attrs(self, kind: str | None) -> str:
        if kind is None or not self.named or self.r.random() < 0.15:
            return self.r.choice(("", "", f' class="c{self.r.randint(1, 999)}"', f' class="css-{self.r.randint(100, 999)}x box wrap"'))
        names = MAIN if kind == "main" else NOISE[kind]
        picked = " ".join(self.r.sample(names, self.r.choice((1, 1, 2))))
        if self.r.random() < 0.3:
            picked += " " + self.r.choice(("container", "wrap", "inner", "row", "col-8", "clearfix", "block", "box"))
        return f' {self.r.choice(("class", "class", "class", "id"))}="{picked}"'

    def raw(self, text: str) -> None:
        self.out.append(text)
        if self.r.random() < 0.15:
            self.out.append(self.r.choice(("\n", "  ", "<!-- x -->", "<script>var a='</p>';f(1<2);</script>", "<style>p{margin:0}</style>")))

    def article_block(self) -> None:
        kind = self.r.choices(("p", "h2", "ul", "quote", "table", "div", "pre", "figure"), (20, 3, 2, 1, 0.6, 1, 0.4, 0.5))[0]
        if kind == "p":
            text = self.prose()
            self.main.append(text)
            shape = self.r.random()
            self.raw(f"<p{self.r.choice(('', '', '', ' class=lead', ' class=x1'))}>" + ("<b>" if shape < 0.05 else "") + self.marked(text) + ("<br>" if shape < 0.1 else "") + ("</p>" if shape < 0.9 and shape > 0.05 else ""))
        elif kind == "h2":
            text = self.sentence(self.r.randint(1, 8))
            self.main.append(text)
            tag = self.r.choice(("h2", "h3", "h4"))
            self.raw(f"<{tag}>{self.marked(text)}</{tag}>")
        elif kind == "ul":
            items = [self.sentence(self.r.randint(2, 14)) for _ in range(self.r.randint(2, 6))]
            self.main.extend(items)
            tag = self.r.choice(("ul", "ol"))
            self.raw(f"<{tag}>" + "".join(f"<li>{self.marked(x)}" + ("</li>" if self.r.random() < 0.9 else "") for x in items) + f"</{tag}>")
        elif kind == "table":
            cells = [[self.word() for _ in range(3)] for _ in range(self.r.randint(2, 4))]
            self.main.extend(x for row in cells for x in row)
            self.raw("<table>" + "".join("<tr>" + "".join(f"<td>{x}</td>" for x in row) + "</tr>" for row in cells) + "</table>")
        else:
            text = self.prose()
            self.main.append(text)
            a, b = {"quote": ("<blockquote><p>", "</p></blockquote>"), "div": ("<div>", "</div>"), "pre": ("<pre>", "</pre>"), "figure": ('<figure><img src="a.png" alt="x"><figcaption>', "</figcaption></figure>")}[kind]
            self.raw(a + self.marked(text) + b)

    def noise_text(self, kind: str, told: bool) -> str:
        """Text of a noise region; where neither tag nor name tells the region, its wording does."""
        x = self.r.random()
        if x < 0.45 or not told:
            return self.r.choice(PHRASES[kind]) + (" " + self.sentence() if self.r.random() < 0.3 and told else "")
        return self.marked(self.prose() if x < 0.75 or kind in ("comments", "ad") else self.sentence(self.r.randint(1, 5)))

    def noise(self, kind: str, inner: bool = False) -> None:
        tag = self.r.choice(_TAGS[kind]) if self.semantic or kind == "form" else "div"
        if kind == "form" and self.semantic:
            tag = "form"
        own = self.attrs(kind)
        while inner and not any(f'"{n}' in own or f" {n}" in own for n in NOISE[kind]) and tag not in ("nav", "footer", "aside", "form", "dialog"):
            own, self.named = self.attrs(kind), True  # inside an article, noise has a name
        told = any(f'"{n}' in own or f" {n}" in own for n in NOISE[kind]) or tag in ("nav", "footer", "aside", "form", "dialog")
        inside = []
        for _ in range(self.r.randint(1, 6) if kind in ("nav", "footer", "aside", "comments", "form") else self.r.randint(1, 2)):
            text = self.noise_text(kind, told)
            if kind in ("nav", "social") or kind in ("footer", "aside") and self.r.random() < 0.6:
                inside.append(f'<li><a href="/{self.r.randint(1, 99)}">{text}</a></li>' if self.r.random() < 0.8 else f'<a href="#">{text}</a> ')
            elif kind == "form":
                inside.append(f"<label>{text}</label><input type=text>" if self.r.random() < 0.6 else f"<button>{text}</button>" if self.r.random() < 0.5 else f"<p>{text}</p>")
            elif kind == "comments":
                inside.append(f"<div{self.attrs('comments')}><b>{self.word()}</b> <p>{text}</p></div>" if self.r.random() < 0.6 else f"<p>{text}</p>" if self.r.random() < 0.6 else f"<li>{text}</li>")
            else:
                inside.append(text if self.r.random() < 0.4 and tag != "ul" else f"<p>{text}</p>" if tag != "p" else text)
        if kind == "aside" and self.r.random() < 0.7:
            inside.insert(0, f"<h3>{self.r.choice(PHRASES['aside'])}</h3>")
        if kind == "comments" and self.r.random() < 0.7:
            inside.insert(0, f"<h3>{self.r.choice(PHRASES['comments'])}</h3>")
        if kind == "nav" and tag != "ul" and self.r.random() < 0.7:
            inside = ["<ul>", *inside, "</ul>"]
        if kind == "header" and self.r.random() < 0.4:
            inside.insert(0, f"<h1><a href='/'>{self.sentence(2)}</a></h1>")
        self.raw(f"<{tag}{own}>" + "".join(inside) + f"</{tag}>")

    def page(self) -> tuple[str, str]:
        """(html, main text)."""
        r = self.r
        title = self.sentence(r.randint(2, 12))
        self.raw(r.choice(("<!DOCTYPE html>", "", "<!doctype HTML>")) + f"<html lang=en><head><meta charset=utf-8><title>{html.escape(title)}</title><style>p{{margin:0}}</style></head><body{r.choice(('', '', ' class=home'))}>")
        top = [k for k in ("notice", "header", "nav", "ad", "form", "social") if r.random() < {"header": 0.6, "nav": 0.8, "notice": 0.3, "ad": 0.4, "form": 0.15, "social": 0.15}[k]]
        r.shuffle(top)
        for k in top:
            self.noise(k)
        wrappers = [f"div{self.attrs(r.choice((None, None, 'main')))}" for _ in range(r.choice((0, 0, 1, 2)))]
        for w in wrappers:
            self.raw(f"<{w}>")
        if r.random() < 0.2:
            self.noise("aside")
        style = r.random()
        holder = ("article" if style < 0.5 else "main" if style < 0.65 else "div") if self.semantic else "div"
        self.raw(f"<{holder}{self.attrs('main') if holder == 'div' or r.random() < 0.4 else ''}>")
        if r.random() < 0.85:
            self.main.append(title)
            head = r.random() < 0.25
            self.raw(("<header>" if head and holder == "article" else "") + f"<h1>{self.marked(title)}</h1>" + ("</header>" if head and holder == "article" else ""))
        for _ in range(r.choice((1, 1, 2, 4, 6, 10, 16, 24, 24, 70))):
            self.article_block()
            if r.random() < 0.08:
                self.noise(r.choice(("ad", "aside", "form", "social", "notice")), True)
        inside = r.random() < 0.35
        ends = [k for k in ("comments", "aside", "form", "social", "ad") if r.random() < {"comments": 0.45, "aside": 0.3, "form": 0.2, "social": 0.2, "ad": 0.2}[k]]
        if inside:
            for k in ends:
                self.noise(k, True)
        if r.random() < 0.95:
            self.raw(f"</{holder}>")
        if not inside:
            for k in ends:
                self.noise(k)
        for _ in wrappers:
            self.raw("</div>")
        tail = [k for k in ("aside", "nav", "notice", "footer") if r.random() < {"aside": 0.3, "nav": 0.15, "notice": 0.2, "footer": 0.85}[k]]
        for k in tail:
            self.noise(k)
        if r.random() < 0.9:
            self.raw("</body></html>")
        return "".join(self.out), "\n".join(" ".join(x.split()) for x in self.main)


def make_page(seed: int) -> tuple[str, str]:
    return PageMaker(seed).page()
