"""Labelled training pages: layouts as they are common on the web, with invented text.

Elements whose text belongs to the article carry ``data-main``, which the features do not see.
"""

from __future__ import annotations

import random

SYLLABLES = "an ber co da el fi gu hor in jo ka lem mi nor os pra qui ran sel tor um ver wo xi yal zen".split()
MAIN = ["<article{m}>|</article>", "<main{m}>|</main>", "<main><article{m}>|</article></main>",
        "<div class='content'{m}>|</div>", "<div id='content'{m}>|</div>", "<div id='main'><div class='post'{m}>|</div></div>",
        "<div class='entry-content'{m}>|</div>", "<div class='article-body'{m}>|</div>", "<section class='story'{m}>|</section>",
        "<table><tr><td class='text'{m}>|</td></tr></table>", "<div{m}>|</div>", "<div class='wrap'><div{m}>|</div></div>",
        "<div class='container'><article class='post'{m}>|</article></div>", "<article{m}>|</article>"]
MENU = ["<nav>{l}</nav>", "<div class='menu'>{l}</div>", "<div id='navigation'>{l}</div>", "<ul class='nav'>{i}</ul>",
        "<nav class='navbar' role='navigation'>{l}</nav>", "<div class='topbar'>{a}</div>",
        "<div class='breadcrumb'>{a}</div>", "<nav aria-label='breadcrumbs'>{l}</nav>", "<div>{a}</div>"]
HEADER = ["<header><h1>{t}</h1><p>{s}</p></header>", "<header><a href='/'>{t}</a>{nav}</header>",
          "<div class='header'><h2>{t}</h2>{s}</div>", "<div id='masthead'>{t}</div>", "<div class='site-header'>{s}</div>",
          "<header class='banner'><div class='logo'>{t}</div><p>{p}</p></header>"]
FOOTER = ["<footer>&copy; {t} &middot; {s}</footer>", "<footer><p>{p}</p>{l}</footer>",
          "<div class='footer'>Copyright 2020 {t}. All rights reserved. {a}</div>", "<div id='footer'><p>{s}</p></div>",
          "<footer class='site-footer'><div>{p}</div><small>&copy; {t}</small></footer>"]
SIDE = ["<aside><h3>{t}</h3>{l}</aside>", "<div class='sidebar'><h3>{t}</h3>{l}<p>{p}</p></div>",
        "<div id='sidebar'><div class='widget'><h4>{t}</h4>{l}</div></div>", "<aside class='related'><h2>{t}</h2>{l}</aside>",
        "<aside><p>{p}</p></aside>", "<div class='related-posts'><h3>{t}</h3>{l}</div>",
        "<section class='recommended'><h3>{t}</h3><p>{p}</p></section>"]
ADVERT = ["<div class='ad'>{s}</div>", "<div class='advert'><p>{p}</p></div>", "<div class='promo'><a href='#'>{s}</a></div>",
          "<div id='ad-top'>{s}</div>", "<section class='sponsored'><h4>{t}</h4><p>{p}</p></section>",
          "<div class='ads'>{p}</div>", "<ins class='adsbygoogle'>{s}</ins>", "<div class='advertisement'>{s}</div>",
          "<aside class='ad-slot'>{p}</aside>", "<div class='banner-ad'><p>{s}</p></div>"]
NOTICE = ["<div class='cookie-banner'><p>{p}</p><button>OK</button></div>", "<div id='consent'>{p} <a href='#'>{w}</a></div>",
          "<div class='notice'>{s}</div>", "<div role='alert'>{s}</div>", "<div class='gdpr-popup'><p>{p}</p></div>",
          "<div class='cookie-notice'>{s}</div>", "<div class='alert'><p>{s}</p></div>", "<div class='modal'><p>{p}</p></div>",
          "<div class='cookies'>{p}</div>", "<div class='disclaimer'>{s}</div>"]
FORM = ["<form><label>{w}</label><input><button>{w}</button></form>", "<div class='newsletter'><p>{s}</p><form><input></form></div>",
        "<form class='search'><label>{s}</label><select><option>{w}<option>{w}</select></form>",
        "<div class='subscribe'><h3>{t}</h3><p>{p}</p></div>", "<form><p>{p}</p><textarea>{s}</textarea></form>",
        "<form id='login'><fieldset><legend>{w}</legend><label>{w}</label></fieldset></form>",
        "<div class='share'>{a}</div>", "<ul class='social'>{i}</ul>", "<div class='pagination'>{a}</div>"]
COMMENTS = ["<section class='comments'><h3>{t}</h3>{c}</section>", "<div id='comments'>{c}</div>",
            "<ol class='comment-list'><li class='comment'><p>{p}</p><li class='comment'><p>{p}</p></ol>",
            "<div class='comment'><b>{w}</b><p>{p}</p></div><div class='comment'><p>{p}</p></div>",
            "<div class='discussion'>{c}</div>", "<section id='comments'><article class='comment'><p>{p}</p></article></section>",
            "<ul class='comments'><li>{p}<li>{p}</ul>", "<div class='responses'><div class='reply'>{p}</div></div>",
            "<section class='user-comments'><h2>{t}</h2><p>{p}</p><p>{s}</p></section>"]
BODY = ["<p>{p}</p>"] * 8 + ["<p>{s}</p>", "<p>{w}.</p>", "<h2>{t}</h2>", "<h3>{s}</h3>", "<ul><li>{s}<li>{p}</ul>",
                             "<blockquote><p>{p}</p></blockquote>", "<p><b>{p}<br>", "<p>{s} <a href='#'>{w}</a> {s}</p>",
                             "<table><tr><td>{w}<td>{s}</table>", "<figure><img><figcaption>{s}</figcaption></figure>",
                             "<pre>{s}</pre>", "<div>{p}</div>", "<ol><li>{s}</li></ol>", "<p><i>{s}</i></p>", "{p}"]


class Writer:
    """Invented text and filled-in patterns; the same seed writes the same pages."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self) -> str:
        return " ".join(self.words(2, 18).capitalize() + "." for _ in range(self.r.randint(1, 9)))

    def fill(self, pattern: str) -> str:
        links = [f"<a href='/{self.word()}'>{self.words(1, 4)}</a>" for _ in range(self.r.randint(1, 7))]
        items = "".join(f"<li>{a}</li>" for a in links)
        kinds = {"w": self.word, "t": lambda: self.words(1, 8).capitalize(), "s": lambda: self.words(3, 15).capitalize() + ".",
                 "p": self.prose, "l": lambda: f"<ul>{items}</ul>", "i": lambda: items, "a": lambda: " | ".join(links),
                 "nav": lambda: f"<nav><ul>{items}</ul></nav>",
                 "c": lambda: "".join(f"<p>{self.prose()}</p>" for _ in range(self.r.randint(1, 5)))}
        for key, make in kinds.items():
            while "{" + key + "}" in pattern:
                pattern = pattern.replace("{" + key + "}", make(), 1)
        return pattern

    def some(self, patterns: list[str], chance: float) -> str:
        return self.fill(self.r.choice(patterns)) if self.r.random() < chance else ""

    def page(self) -> str:
        body = ["<h1>" + self.words(3, 10).capitalize() + "</h1>" if self.r.random() < 0.8 else ""]
        if self.r.random() < 0.15:
            body = ["<header>" + (body[0] or "<h1>" + self.word() + "</h1>") + "</header>"]
        for _ in range(self.r.randint(1, 14)):
            body.append(self.fill(self.r.choice(BODY)))
            aside = self.some(ADVERT + FORM[-3:] + SIDE[3:5], 0.06)
            body.append(f"<div data-other>{aside}</div>" if aside else "")
        if self.r.random() < 0.25:
            body.append(f"<div data-other>{self.some(COMMENTS, 1)}</div>")
        opening, closing = self.r.choice(MAIN).split("|")
        main = opening.replace("{m}", " data-main") + "".join(body) + closing
        before = [self.some(NOTICE, 0.3), self.some(HEADER, 0.5), self.some(MENU, 0.8), self.some(ADVERT, 0.5),
                  self.some(FORM, 0.2), self.some(SIDE, 0.25)]
        after = [self.some(FORM, 0.25), self.some(COMMENTS, 0.35), self.some(SIDE, 0.35), self.some(ADVERT, 0.25),
                 self.some(MENU, 0.1)]
        self.r.shuffle(before)
        self.r.shuffle(after)
        return (f"<!DOCTYPE html><html><head><title>{self.word()}</title></head><body>{''.join(before)}{main}"
                f"{''.join(after)}{self.some(FOOTER, 0.8)}{self.some(NOTICE, 0.15)}</body></html>")


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    writer = Writer(seed)
    return [writer.page() for _ in range(n)]
