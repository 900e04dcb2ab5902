"""Made-up pages whose main text is known, to train and test the extraction on: many layouts, with and without telling names."""

from __future__ import annotations

import html
import random

#: Names that sites give the parts of a page; the first of a row is the most usual.
NAMES = {
    "main": "content article main post entry story article-body post-content entry-content main-content page-content text body-copy".split(),
    "nav": "nav navbar menu navigation main-menu topnav breadcrumbs tabs pagination nav-links".split(),
    "header": "header site-header masthead page-header top-bar branding".split(),
    "footer": "footer site-footer page-footer colophon bottom copyright footer-links".split(),
    "side": "sidebar side aside widget related recommended right-rail trending most-read".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo ad-slot banner-ad".split(),
    "notice": "cookie-notice notice cookie-banner consent gdpr alert newsletter popup overlay subscribe".split(),
    "comments": "comments comment comment-list discussion replies responses feedback".split(),
    "form": "form search search-form login signup contact-form".split(),
    "share": "share social sharing share-buttons follow-us".split(),
}
ELEMENTS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section", "main": "article"}


class Maker:
    """html() gives a page with {{ }} around its main text's elements as (page, blocks): blocks are the texts that an extraction should return."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        alphabet = self.rng.choice(["abcdefghilmnoprstuv", "aeioudrtnsmléüñçßgk", "абвгдеиклмнопрстуя"])
        self.stems = ["".join(self.rng.choices(alphabet, k=self.rng.randint(1, 5))) for _ in range(120)]
        self.blocks: list[str] = []
        self.telling = self.rng.random() < 0.75
        self.semantic = self.rng.random() < 0.65

    def word(self) -> str:
        return "".join(self.rng.choices(self.stems, k=self.rng.choice((1, 1, 1, 2, 2, 3))))

    def sentence(self, low: int = 1, high: int = 22) -> str:
        words = [self.word() for _ in range(self.rng.randint(low, high))]
        return (" ".join(w + ("," if self.rng.random() < 0.08 else "") for w in words)).capitalize().rstrip(",") + self.rng.choice("......!?")

    def prose(self, most: int = 9) -> str:
        return " ".join(self.sentence() for _ in range(self.rng.randint(1, most)))

    def label(self) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(1, 3))).capitalize()

    def attributes(self, kind: str) -> str:
        rng = self.rng
        if self.telling or rng.random() < 0.3:
            name = rng.choice(NAMES[kind]) if rng.random() < 0.6 else NAMES[kind][0]
            return f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", "", f" c{rng.randint(1, 99)}", "-1"])}"'
        return rng.choice(["", f' class="x{rng.randint(10, 999)}"'])

    def element(self, kind: str) -> tuple[str, str]:
        """Begin and end of an element of this kind: by its tag, by a name, or both; at least one of the two tells what it is."""
        named = ELEMENTS.get(kind, "div")
        if self.semantic and named != "div" or self.rng.random() < 0.3:
            tag = "main" if kind == "main" and self.rng.random() < 0.15 else named
            return f"<{tag}{self.attributes(kind) if self.rng.random() < 0.5 else ''}>", f"</{tag}>"
        tag = self.rng.choice(["div", "div", "div", "section", "td"] if kind == "main" else ["div", "div", "section"])
        name = self.attributes(kind)
        if kind != "main" and not any(x in name for x in NAMES[kind]):
            name = f' class="{self.rng.choice(NAMES[kind])}"'
        return (f"<table><tr><td{name}>", "</td></tr></table>") if tag == "td" else (f"<{tag}{name}>", f"</{tag}>")

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{self.word()}">{self.label()}</a></{tag}>' for _ in range(self.rng.randint(2, 9)))

    def other(self, kind: str) -> str:
        """A part that is no main text."""
        rng = self.rng
        begin, end = self.element(kind)
        if kind == "nav":
            inner = f"<ul>{self.links()}</ul>" if rng.random() < 0.7 else " | ".join(f'<a href="#{i}">{self.label()}</a>' for i in range(rng.randint(2, 8)))
        elif kind == "header":
            inner = f'<a href="/">{self.label()}</a>' + rng.choice(["", f"<p>{self.sentence(2, 6)}</p>", f"<h2>{self.label()}</h2>", f"<span>{self.label()}</span>"])
            inner += self.other("nav") if rng.random() < 0.4 else ""
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "", "© 2021 "]) + rng.choice([f"{self.word()}.example.net &middot; {self.sentence()}", self.label(), self.prose(2)])
            inner += f"<ul>{self.links()}</ul>" if rng.random() < 0.4 else ""
            inner = f"<p>{inner}</p>" if rng.random() < 0.3 else inner
        elif kind == "side":
            inner = "".join(rng.choice([f"<h3>{self.label()}</h3>", f"<ul>{self.links()}</ul>", f"<p>{self.prose(2)}</p>", f'<div><a href="/x"><h4>{self.sentence(3, 9)}</h4></a><p>{self.sentence(4, 14)}</p></div>']) for _ in range(rng.randint(1, 4)))
        elif kind == "ad":
            inner = rng.choice([self.prose(3), f'<a href="//ads.example/{self.word()}">{self.sentence(2, 8)}</a>', f'<p>{self.sentence(2, 12)}</p><a href="/buy">{self.label()}</a>', '<img src="b.gif">' + self.label()])
        elif kind == "notice":
            inner = f"<p>{self.prose(2)}</p>" + rng.choice(["", f"<button>{self.label()}</button>", f'<a href="/privacy">{self.label()}</a>'])
            inner = self.prose(2) if rng.random() < 0.2 else inner
        elif kind == "comments":
            each = lambda: f'<div{self.attributes("comments")}><b>{self.label()}</b> <small>{rng.randint(1, 59)} min</small><p>{self.prose(4)}</p></div>'
            inner = f"<h3>{self.label()}</h3>" * (rng.random() < 0.6) + "".join(each() for _ in range(rng.randint(1, 5)))
            inner = "<ol>" + "".join(f"<li>{self.prose(3)}</li>" for _ in range(rng.randint(1, 4))) + "</ol>" if rng.random() < 0.2 else inner
        elif kind == "form":
            inner = f'<label>{self.label()}</label><input name="q"><button>{self.label()}</button>' + rng.choice(["", f"<p>{self.sentence(2, 9)}</p>", f"<textarea>{self.label()}</textarea>", f"<select><option>{self.label()}<option>{self.label()}</select>"])
        else:
            inner = "".join(f'<a href="//{self.word()}.example/s">{self.label()}</a> ' for _ in range(rng.randint(2, 5)))
        return begin + inner + end

    def keep(self, tag: str, text: str, attributes: str = "") -> str:
        """An element of main text."""
        self.blocks.append(text)
        marked = html.escape(text, quote=False)
        if tag == "p" and self.rng.random() < 0.25:
            words = marked.split(" ")
            i = self.rng.randrange(len(words))
            words[i] = self.rng.choice(["<b>{}</b>", "<em>{}</em>", '<a href="/y">{}</a>', "<span>{}</span>", "<i>{}</i>"]).format(words[i])
            marked = " ".join(words)
        return f"<{tag}{attributes}>{marked}</{tag}>"

    def article(self) -> str:
        rng = self.rng
        title = self.sentence(2, 14)[: rng.choice((60, 200))].strip()
        head = self.keep("h1", title)
        if rng.random() < 0.12:
            head = f"<header>{head}</header>"
        out = [head]
        for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 8, 13, 20))):
            kind = rng.random()
            if kind < 0.7:
                out.append(self.keep("p", self.prose()))
            elif kind < 0.76:
                out.append(self.keep(rng.choice(["h2", "h3"]), self.label()))
            elif kind < 0.8:
                text = self.prose(2)
                self.blocks.append(text)
                out.append(f"<p><b>{text}<br>")
            elif kind < 0.84:
                items = [self.keep("li", self.sentence()) for _ in range(rng.randint(1, 5))]
                out.append(f"<{'ul' if kind < 0.82 else 'ol'}>{''.join(items)}</{'ul' if kind < 0.82 else 'ol'}>")
            elif kind < 0.87:
                out.append(f"<blockquote>{self.keep('p', self.prose(3))}</blockquote>")
            elif kind < 0.89:
                out.append(self.keep("div", self.prose(4)))
            elif kind < 0.91:
                out.append(f'<figure><img src="i.jpg">{self.keep("figcaption", self.sentence())}</figure>')
            elif kind < 0.93:
                out.append("<table>" + "".join(f"<tr>{self.keep('td', self.label())}{self.keep('td', str(rng.randint(1, 999)))}</tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.96:
                out.append(self.other("ad"))
            elif kind < 0.98:
                out.append(self.other(rng.choice(["share", "notice", "form", "side", "nav"])))
            else:
                out.append(self.keep("pre", self.label()))
        return "".join(out)

    def page(self) -> str:
        rng = self.rng
        begin, end = self.element("main")
        wrapped = rng.random() < 0.4
        before = [self.other(k) for k, p in (("notice", 0.2), ("header", 0.45), ("nav", 0.7), ("form", 0.15), ("ad", 0.45), ("side", 0.12), ("share", 0.1)) if rng.random() < p]
        if rng.random() < 0.3:
            rng.shuffle(before)
        main = begin + self.article() + (self.other("comments") if rng.random() < 0.08 else "") + end
        after = [self.other(k) for k, p in (("share", 0.12), ("ad", 0.25), ("comments", 0.35), ("side", 0.3), ("form", 0.12), ("notice", 0.12), ("nav", 0.1), ("footer", 0.8)) if rng.random() < p]
        body = "".join(before) + main + "".join(after)
        if wrapped:
            body = f'<div{rng.choice(["", " id=page", " class=wrapper", " class=container"])}>{body}</div>'
        head = f'<head><meta charset="utf-8"><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var a="</div>";</script></head>'
        return f"<!DOCTYPE html><html>{head}<body>{body}" + ("</body></html>" if rng.random() < 0.85 else "")


def made_page(seed: int) -> tuple[str, str]:
    """A page, and its main text."""
    maker = Maker(seed)
    source = maker.page()
    return source, "\n".join(" ".join(x.split()) for x in maker.blocks)
