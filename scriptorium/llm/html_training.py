"""Labelled pages for training the extractor, made here: layouts drawn at random from a grammar of page parts.

Run ``python -m scriptorium.llm.html_training`` to train anew and write the model file beside this module.
"""

from __future__ import annotations

import random
from html import escape
from pathlib import Path

from scriptorium.llm.html_blocks import leaf_blocks
from scriptorium.llm.html_crf import Model, train

MODEL_FILE = Path(__file__).with_name("html_crf.json")
_SYLLABLES = "ba co da el fi gu ha in jo ka lo ma ne or pa qui re sa te un va wi xo ya zu st tr".split()
#: Everyday words, which stand in articles and in furniture alike.
_WORDS = (
    "the of and to in for is on that by this with you it not or be are from at as your all have new more an was we will home can us about if page my has search free but our one"
    " other do no information time they site he up may what which their news out use any there see only so his when contact here business who web also now help get view online"
    " cookie cookies newsletter copyright comment comments reader share advertisement privacy policy article story rights reserved subscribe"
).split()
#: Sentences that stand in articles as often as in page feet.
_LOOKALIKES = (
    "All rights reserved.", "Copyright belongs to the author.", "© 2020 the author.", "Bake the cookie until brown.", "Subscribe to reason.", "An advertisement is a claim.",
    "The company says that its sites use cookies.", "Sign up for the course by Friday.", "We use cookies in this recipe.", "He says: nothing is lost.", "Share the work.", "More on that below.",
)
#: What furniture says.
_NOTICES = (
    "We use cookies to improve your experience.", "This site uses cookies. By continuing you agree.", "Accept all cookies", "See our cookie policy for details.", "We and our partners use cookies to show ads.",
    "Nous utilisons des cookies.", "Wir verwenden Cookies.", "Utilizamos cookies propias.",
)
_FEET = ("Copyright 2024 {0} Inc. All rights reserved.", "© 2023 {0}. All rights reserved.", "All rights reserved.", "© {0}", "Copyright © 2019 {0}", "Tous droits réservés.", "Alle Rechte vorbehalten.")
_LETTERS = ("Subscribe to our newsletter", "Sign up for our newsletter", "Subscribe to the newsletter for weekly news.", "Join our mailing list today.", "Sign up to get updates by mail.")
_ACCOUNTS = ("Log in", "Sign in", "Register", "Sign up", "Login", "My account", "Forgot your password?")
_SHARES = ("Share this", "Share on Facebook", "Tweet this", "Follow us", "Share")
_MORES = ("Related articles", "More stories", "Recommended for you", "Popular posts", "Trending now", "You may also like", "Read more", "Advertisement")
_TALKS = ("{0} says: {1}", "{0} wrote: {1}", "{0} commented: {1}", "3 comments", "Leave a reply", "Leave a comment", "Reply", "12 responses to this story")
_MARK = "\u2063"  # an invisible separator that labels main text; no other text has it


class _Maker:
    def __init__(self, seed: int) -> None:
        self.random = random.Random(seed)
        self.english = False  # whether a page's words are everyday ones
        self.held = True  # whether an element says that it holds the main text; without one, lookalikes can't be told

    def word(self) -> str:
        if self.english:
            return self.random.choice(_WORDS)
        return "".join(self.random.choices(_SYLLABLES, k=self.random.randint(1, 4)))

    def sentence(self, least: int = 1, most: int = 18) -> str:
        words = [self.word() for _ in range(self.random.randint(least, most))]
        return " ".join(words).capitalize() + self.random.choice("....!?")

    def prose(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.sentence() for _ in range(self.random.randint(least, most)))

    def name(self, *choices: str) -> str:
        chosen = self.random.choice(choices)
        return self.random.choice((f' class="{chosen}"', f' id="{chosen}"', f' class="x {chosen}-box"'))

    def links(self, least: int = 2, most: int = 8, tag: str = "li") -> str:
        items = "".join(f'<{tag}><a href="/{self.word()}">{self.word()}</a></{tag}>' for _ in range(self.random.randint(least, most)))
        return f"<ul>{items}</ul>" if tag == "li" else items

    def furniture(self, plain: bool = True) -> str:
        """A part of site furniture; unnamed ones only where ``plain``, as inside an article nothing tells them apart."""
        r = self.random
        return r.choice(
            (
                lambda: f"<nav>{self.links()}</nav>",
                lambda: f"<div{self.name('menu', 'navbar', 'breadcrumbs', 'pagination')}>{self.links(tag=r.choice(('li', 'span')))}</div>",
                lambda: f"<header><h1><a href='/'>{self.word()}</a></h1>{self.links()}</header>",
                lambda: f"<header><div>{self.sentence(1, 5)}</div><p>{self.prose(1, 2)}</p></header>",
                lambda: f"<aside{r.choice(('', self.name('sidebar', 'related')))}><h3>{self.word()}</h3><p>{self.prose(1, 3)}</p>{self.links()}</aside>",
                lambda: f"<div{self.name('sidebar', 'widget', 'trending', 'related')}><h4>{self.word()}</h4><p>{self.prose(1, 3)}</p></div>",
                lambda: f"<div{self.name('ad', 'ads', 'advert', 'sponsored', 'promo')}>{self.prose(1, 3)}</div>",
                lambda: f"<div{self.name('ad', 'banner', 'advertisement')}><p>{self.prose(1, 3)}</p></div>",
                lambda: f"<div{self.name('cookie-notice', 'notice', 'alert', 'consent', 'popup')}><p>{self.prose(1, 2)}</p><button>{self.word()}</button></div>",
                lambda: f"<form{r.choice(('', self.name('newsletter', 'login', 'search')))}><label>{self.sentence(1, 4)}</label><input name='q'><p>{self.prose(1, 2)}</p><button>{self.word()}</button></form>",
                lambda: f"<div>{self.links(tag='span')}</div>",
                lambda: f"<p><a href='/{self.word()}'>{self.sentence(1, 4)}</a></p>",
                lambda: f"<div{self.name('newsletter', 'signup', 'subscribe', 'login', 'search')}><p>{self.prose(1, 2)}</p></div>",
                lambda: f"<div{self.name('header', 'masthead', 'topbar')}><p>{self.prose(1, 2)}</p></div>",
                lambda: f"<div{self.name('share', 'social', 'follow')}><p>{self.prose(1, 2)}</p></div>",
                lambda: f"<{t}>{self.prose(1, 2)}</{t}>" if (t := r.choice(("nav", "footer", "button", "dialog"))) else "",
                lambda: f"<div{self.name('share', 'social')}>{self.links(tag='span')}</div>",
                lambda: f"<div{self.name('popup', 'modal')} hidden><p>{self.prose(1, 2)}</p></div>",
                lambda: f"<aside><article{r.choice(('', self.name('teaser', 'card')))}><h3><a href='/x'>{self.sentence(2, 5)}</a></h3><p>{self.prose(1, 2)}</p></article></aside>",
                *[self.plain_furniture] * 6 * plain,
            )
        )()

    def plain_furniture(self) -> str:
        """Furniture that no name gives away, only its words and its place."""
        r = self.random
        text = r.choice(r.choice((_NOTICES, _NOTICES, _LETTERS, _ACCOUNTS, _SHARES, _MORES)))
        return r.choice((f"<div>{text}</div>", f"<div><p>{text}</p></div>", f"<p>{text}</p>", f"<div>{text} <a href='/p'>{self.word()}</a></div>", f"<section><p>{text}</p><button>OK</button></section>"))

    def plain_comments(self) -> str:
        """Readers' comments in elements without names."""
        r = self.random
        each = [r.choice(_TALKS).format(self.word().capitalize(), self.prose(1, 2)) for _ in range(r.randint(1, 4))]
        tag = r.choice(("p", "div", "li"))
        items = "".join(f"<{tag}>{e}</{tag}>" for e in each)
        return f"<ul>{items}</ul>" if tag == "li" else r.choice((f"<div>{items}</div>", f"<section><h3>Comments</h3>{items}</section>", items))

    def comments(self) -> str:
        r = self.random
        each = "".join(f"<{t}{self.name('comment', 'reply')}><b>{self.word()}</b><p>{self.prose(1, 3)}</p></{t}>" for t in r.choices(("div", "li"), k=r.randint(1, 5)))
        tag = r.choice(("section", "div", "ul"))
        return f"<{tag}{self.name('comments', 'discussion', 'replies')}><h3>{self.word()}</h3>{each}</{tag}>"

    def foot(self) -> str:
        text = f"&copy; {self.word()}.example &middot; {self.prose(1, 2)}"
        if self.random.random() < 0.4:
            said = self.random.choice(_FEET).format(self.word().capitalize())
            return self.random.choice((f"<div>{said}</div>", f"<p>{said}</p>", f"<div><p>{said}</p></div>", f"<footer>{said}</footer>"))
        return self.random.choice((f"<footer>{text}</footer>", f"<footer><p>{text}</p>{self.links()}</footer>", f"<div{self.name('footer', 'copyright')}>{text}</div>"))

    def main_part(self) -> str:
        r = self.random
        text = lambda a, b: escape(self.prose(a, b)) + _MARK
        return r.choice(
            (
                *[lambda: f"<p>{text(1, 6)}</p>"] * 6,
                lambda: f"<p>{escape(self.sentence(1, 2))}{_MARK}</p>",
                lambda: f"<p>{text(1, 3)} <a href='/{self.word()}'>{self.word()}</a> {text(1, 2)}</p>",
                lambda: f"<p><b>{escape(self.sentence())}{_MARK}<br><p>{text(1, 4)}</p>",
                lambda: f"<h2>{self.word()} {self.word()}{_MARK}</h2><p>{text(1, 4)}",
                lambda: "<ul>" + "".join(f"<li>{escape(self.sentence(1, 9))}{_MARK}" for _ in range(r.randint(2, 5))) + "</ul>",
                lambda: f"<p>{r.choice(_LOOKALIKES) if self.held else self.sentence(3)}{_MARK}</p>",
                lambda: f"<blockquote>{text(1, 2)}</blockquote>",
                lambda: f"<pre>{text(1, 2)}</pre>",
                lambda: f"<div>{text(1, 5)}</div>",
                lambda: f"<table><tr><td>{self.word()}{_MARK}<td>{self.word()}{_MARK}</table>",
                lambda: f"<figure><img src='x'><figcaption>{text(1, 1)}</figcaption></figure>",
                lambda: f"<noscript><p>{text(1, 2)}</p></noscript>",
                lambda: f"<p>{text(1, 1)} <math><mi>{self.word()}</mi></math></p>",
                lambda: f"<dl><dt>{self.word()}{_MARK}<dd>{text(1, 1)}</dl>",
            )
        )()

    def page(self) -> str:
        r = self.random
        self.english = r.random() < 0.5
        opening, closing = r.choice(
            (
                ("<article>", "</article>"),
                ("<article>", "</article>"),
                ("<main>", "</main>"),
                ("<main><article>", "</article></main>"),
                (f"<article{self.name('post', 'entry')}>", "</article>"),
                (f"<div{self.name('content', 'article', 'post', 'main', 'entry')}>", "</div>"),
                (f"<section{self.name('story', 'article-body', 'main-content')}>", "</section>"),
                ("<div><div>", "</div></div>"),
                ("", ""),
            )
        )
        self.held = any(word in opening for word in ("article", "main", "content", "post", "entry", "story"))
        title = f"<h1>{self.sentence(2, 8)}{_MARK}</h1>"
        parts = [title] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 10)):
            parts.append(self.main_part())
            if r.random() < 0.15:
                parts.append(self.furniture(plain=False))
        if r.random() < 0.3:
            parts.append(self.comments())
        if "article" in opening and parts[0] == title and r.random() < 0.4:
            by = r.choice(("", f"<p>{self.sentence(2, 4)}{_MARK}</p>"))
            parts[0] = f"<header{r.choice(('', self.name('entry-header', 'post-header')))}>{title}{by}</header>"
        if opening and r.random() < 0.3:  # names that tell of the layout, or of another part of the page
            wrapper = r.choice(("page with-sidebar", "has-sidebar", "layout no-sidebar", "wrapper", "container open-comments"))
            opening, closing = f'<div class="{wrapper}">{opening}', f"{closing}</div>"
        if ("<article" in opening or "<main" in opening) and r.random() < 0.15:  # a container whose name is about one of its parts
            opening, closing = f"<div{self.name('sidebar-layout', 'comments-enabled', 'menu-page')}>{opening}", f"{closing}</div>"
        before = "".join(self.furniture() for _ in range(r.randint(0, 4)))
        after = "".join(self.furniture() for _ in range(r.randint(0, 3)))
        after += self.comments() if r.random() < 0.3 else ""
        after += self.plain_comments() if "article" in opening + closing and r.random() < 0.3 else ""
        after += self.foot() if r.random() < 0.9 else ""
        end = "</body></html>" if r.random() < 0.9 else ""
        head = f"<head><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        body = r.choice(("<body>", "<body>", '<body class="single open-comments">', '<body class="page sidebar-right">', '<body id="nav-top">'))
        return f"<!DOCTYPE html><html>{head}{body}{before}{opening}{''.join(parts)}{closing}{after}{end}"


def labelled_pages(count: int, seed: int = 1) -> list[tuple[list, list[int]]]:
    """Blocks and labels of ``count`` pages. A block is main text if it holds the mark, which is then taken out."""
    maker, out = _Maker(seed), []
    for _ in range(count):
        blocks = leaf_blocks(maker.page())
        labels = [int(_MARK in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace(_MARK, "")
        out.append((blocks, labels))
    return out


def trained(count: int = 2400, seed: int = 1) -> Model:
    return train(labelled_pages(count, seed))


if __name__ == "__main__":
    MODEL_FILE.write_text(trained().to_json() + "\n")
