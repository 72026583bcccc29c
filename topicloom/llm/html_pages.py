"""Labelled pages that the extraction model learns from, drawn from a seeded grammar of page layouts."""

from __future__ import annotations

import random

_SYLLABLES = "an ber con da en fil ge hor is jo kel lo mi nu or pe qua re sta tu un ver wi xe yo za é ü ñ ße".split()


class _Draw:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def some(self, *values):
        return self.r.choice(values)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentence(self, low: int = 1, high: int = 18) -> str:
        return self.words(low, high).capitalize() + self.some(".", ".", ".", "!", "?", ",")

    def prose(self, low: int, high: int) -> str:
        out = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.15:
            out = out.replace(" ", self.some(" &amp; ", "%%% ", "&nbsp;"), 3)
        if self.r.random() < 0.2:
            out = f"<{self.some('b', 'em', 'strong', 'i')}>{out}" + self.some("</b>", "<br>", "")
        if self.r.random() < 0.15:
            out += f' <a href="/{self.word()}">{self.words(1, 4)}</a> {self.sentence()}'
        return out

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(n))

    def attrs(self, *names: str) -> str:
        name = self.some(*names)
        return self.some(f' class="{name}"', f' id="{name}"', f' class="{self.word()} {name}"', f' class="{name}-{self.word()}"', f' class="{self.word()}_{name}"')

    def junk(self) -> str:
        """A part that isn't the article."""
        n = self.r.randint(1, 8)
        text = self.prose(1, 3) if self.r.random() < 0.6 else self.words(1, 12)
        kind = self.r.randrange(14)
        if kind == 0:
            return f"<nav{self.some('', self.attrs('nav', 'menu'))}><ul>{self.links(n)}</ul></nav>"
        if kind == 1:
            return f"<div{self.attrs('nav', 'menu', 'navbar', 'breadcrumb')}><ul>{self.links(n)}</ul></div>"
        if kind == 2:
            return f"<header>{self.some('', '<h1>' + self.words(1, 4) + '</h1>')}<p>{text}</p></header>"
        if kind == 3:
            return f"<footer>{self.some('&copy; ', '')}{self.word()}.example &middot; {text}{self.some('', '<p>' + text + '</p>')}</footer>"
        if kind == 4:
            return f"<aside{self.some('', self.attrs('sidebar'))}><h3>{self.words(1, 4)}</h3><p>{text}</p><ul>{self.links(n)}</ul></aside>"
        if kind == 5:
            return f"<div{self.attrs('ad', 'ads', 'advert', 'sponsored', 'promo')}>{self.some(text, '<p>' + text + '</p>')}</div>"
        if kind == 6:
            return f"<div{self.attrs('cookie', 'notice', 'consent', 'alert', 'popup')}>{self.some(text, '<p>' + text + '</p>')}</div>"
        if kind in (7, 8):
            who = "".join(f"<{(t := self.some('div', 'li', 'article'))}{self.attrs('comment', 'reply')}><p>{self.prose(1, 4)}</p></{t}>" for _ in range(n))
            return f"<{(t := self.some('div', 'section'))}{self.attrs('comments', 'discussion', 'replies')}><h3>{self.words(1, 3)}</h3>{who}</{t}>"
        if kind == 9:
            return f"<form{self.some('', self.attrs('search', 'login', 'subscribe'))}><p>{text}</p><label>{self.words(1, 3)}</label><input name=q><button>{self.word()}</button></form>"
        if kind == 10:
            return f"<div{self.attrs('sidebar', 'related', 'widget', 'popular')}><h4>{self.words(1, 4)}</h4><p>{text}</p><ul>{self.links(n)}</ul></div>"
        if kind == 11:
            return f"<div{self.attrs('footer', 'copyright', 'legal')}><p>{text}</p></div>"
        if kind == 12:
            return f"<div{self.attrs('share', 'social', 'follow')}>{''.join(f'<a href=#>{self.word()}</a> ' for _ in range(n))}</div>"
        return f"<div{self.attrs('header', 'masthead', 'topbar')}><p>{text}</p></div>"

    def body(self) -> list[tuple[str, bool]]:
        """Parts of an article, a few of them not its own."""
        out = [(f"<h1>{self.words(1, 10)}</h1>", True)] if self.r.random() < 0.85 else []
        for _ in range(self.r.randint(1, 9)):
            kind = self.r.random()
            if kind < 0.7:
                out.append((f"<p>{self.prose(1, 7)}" + self.some("</p>", "</p>", "</p>", ""), True))
            elif kind < 0.75:
                out.append((f"<h2>{self.words(1, 6)}</h2>", True))
            elif kind < 0.8:
                out.append((f"<ul>{''.join(f'<li>{self.prose(1, 2)}</li>' for _ in range(self.r.randint(1, 5)))}</ul>", True))
            elif kind < 0.84:
                out.append((f"<blockquote><p>{self.prose(1, 3)}</p></blockquote>", True))
            elif kind < 0.87:
                out.append((f"<table><tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr></table>", True))
            elif kind < 0.89:
                out.append((f"<pre>{self.words(1, 20)}</pre>", True))
            elif kind < 0.93:
                out.append((f"<div><p>{self.prose(1, 4)}</p></div>", True))
            else:
                out.append((self.junk(), False))
        return out

    def page(self) -> list[tuple[str, bool]]:
        """(markup, whether its text belongs to the article) in page order."""
        out = [(self.junk(), False) for _ in range(self.r.randint(0, 4))]
        wrap = self.some("article", "article", "main", "div", "section")
        attrs = self.attrs("content", "article", "post", "main", "entry", "story") if wrap in ("div", "section") else self.some("", self.attrs("post", "entry"))
        shell = self.r.random() < 0.4
        outer = f"<div{self.some('', self.attrs('page', 'wrapper', 'container', 'main', 'content'))}>" if shell else ""
        out.append((f"{outer}<{wrap}{attrs}>", True))
        out += self.body()
        out.append((f"</{wrap}>", True))
        out += [(self.junk(), False) for _ in range(self.r.randint(0, 4))]
        return out + [("</div>", False)] * shell


def labelled_pages(n: int, seed: int = 0):
    """n pages as lists of (markup, belongs to the article)."""
    for k in range(n):
        yield _Draw(1_000_003 * seed + k).page()
