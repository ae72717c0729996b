"""Pages composed for training the block labeller: many layouts around given texts, labels known."""

from __future__ import annotations

import random

#: How sites name things; one of each list is drawn for a page.
CONTENT = ["article", "main", "section.entry-content", "div.post-content", "div#content", "div.article-body", "div.story", "div.text", "div.post", "div.entry", "main article", "div#main div.content", "section.body", "div.single-post article.post", "td.main", "div.page-content", "article.post-body"]
NAV = ["nav", "div.menu", "div#nav", "ul.navbar", "header nav.main-nav", "div.navigation", "div.breadcrumbs", "nav.top", "div.topbar", "ul.menu"]
HEADER = ["header", "div#header", "div.site-header", "div.masthead", "header.top", "div.branding"]
FOOTER = ["footer", "div#footer", "div.site-footer", "div.footer", "footer.bottom", "div.copyright", "div.legal"]
SIDE = ["aside", "div.sidebar", "div#sidebar", "div.widget", "aside.related", "div.related-posts", "section.recommended", "div.trending", "div.popular"]
ADVERT = ["div.ad", "div.advert", "div.banner", "div.sponsored", "aside.promo", "div.ads", "ins.adsbygoogle", "section.ad-slot", "div.advertisement", "div.promo-box"]
NOTICE = ["div.cookie-notice", "div#cookies", "div.consent", "div.notice", "div.alert", "div.newsletter", "div.gdpr-banner", "div.popup", "section.subscribe"]
COMMENTS = ["div#comments", "section.comments", "div.comment-list", "ol.commentlist", "div.disqus", "div.responses", "section.reader-comments", "ul.comments"]
FORM = ["form", "form.search", "form#login", "div.signup form", "form.contact", "form.newsletter"]
PAGE = ["", "", "div#page", "div.wrapper", "div.container", "div#page div.wrap", "div.site", "div.layout"]
SHARE = ["div.share", "ul.social", "div.share-buttons", "div.meta", "div.byline", "div.tags", "p.author-info"]

#: Short texts of page furniture.
UI = "Home|About|Contact|Log in|Sign up|Search|Menu|Products|News|Blog|Archive|Help|FAQ|Privacy policy|Terms of use|Sitemap|Next|Previous|Read more|Share|Tweet|Subscribe|Reply|Report|Categories|Tags|Follow us|RSS|Careers|Press|Support|Download|Back to top|Shop|Cart|Account|Settings|Advertise|Newsletter|Inicio|Contacto|Accueil|Startseite|Impressum|Kontakt".split("|")
NOTICES = ["We use cookies to improve your experience. By continuing you agree to our cookie policy.", "This site uses cookies.", "Accept all cookies", "Subscribe to our newsletter and never miss a story.", "You have read all of your free pages this month.", "JavaScript must be enabled to use this site.", "Please disable your ad blocker.", "Sign up for updates"]
FOOTERS = ["© {} All rights reserved.", "&copy; {} · {}", "Copyright 2024 {}", "&copy; {} &middot; {}", "Powered by {}", "{} Inc., all rights reserved", "Terms of use | Privacy | {}"]


def _open(spec: str) -> tuple[str, str]:
    start, end = "", ""
    for part in spec.split():
        tag, mark, name = part.partition("#") if "#" in part else part.partition(".")
        start += f"<{tag}" + (f' {"id" if mark == "#" else "class"}="{name}"' if mark else "") + ">"
        end = f"</{tag}>" + end
    return start, end


def _wrap(spec: str, inner: str) -> str:
    start, end = _open(spec)
    return start + inner + end


def compose(rng: random.Random, texts: list[str], shorts: list[str]) -> tuple[str, list[str]]:
    """A page and a mark for each of its blocks in page order; content blocks carry the mark '1'.

    The texts must be free of markup. Each block's text begins with a serial number in braces, which
    labels() takes out again.
    """
    marks: list[str] = []

    def t(text: str, content: bool) -> str:
        marks.append("1" if content else "0")
        return "{%d}" % (len(marks) - 1) + text.replace("&", "&amp;").replace("<", "&lt;")

    def raw(text: str) -> str:
        marks.append("0")
        return "{%d}" % (len(marks) - 1) + text

    short = lambda: rng.choice(UI) if rng.random() < 0.5 else rng.choice(shorts)
    long = lambda: rng.choice(texts)
    item = lambda s: f'<a href="/{rng.randrange(99)}">{t(s, False)}</a>' if rng.random() < 0.85 else t(s, False)

    def links(spec: str, n: int) -> str:
        if rng.random() < 0.7:
            return _wrap(spec if spec.startswith("ul") else spec + " ul", "".join(f"<li>{item(short())}</li>" for _ in range(n)))
        return _wrap(spec, "".join(f"<div>{item(short())}</div>" for _ in range(n)))

    def advert() -> str:
        return _wrap(rng.choice(ADVERT), t(" ".join(long().split()[: rng.randint(2, 30)]), False))

    def notice() -> str:
        return _wrap(rng.choice(NOTICE), f"<p>{t(rng.choice(NOTICES), False)}</p>" + (f"<button>{rng.choice(UI)}</button>" if rng.random() < 0.3 else ""))

    def form() -> str:
        return _wrap(rng.choice(FORM), f"<label>{t(short(), False)}</label><input name=q>" + (f"<p>{t(short(), False)}</p>" if rng.random() < 0.5 else ""))

    def side() -> str:
        inner = f"<h{rng.choice('34')}>{t(short(), False)}</h3>" if rng.random() < 0.6 else ""
        for _ in range(rng.randint(1, 4)):
            inner += f"<p>{item(' '.join(long().split()[: rng.randint(3, 14)]))}</p>" if rng.random() < 0.6 else f"<div>{t(' '.join(long().split()[:25]), False)}</div>"
        return _wrap(rng.choice(SIDE), inner)

    def comments() -> str:
        inner = f"<h3>{t(rng.choice(['Comments', 'Leave a reply', '3 responses', short()]), False)}</h3>" if rng.random() < 0.7 else ""
        for _ in range(rng.randint(1, 6)):
            body = t(" ".join(long().split()[: rng.randint(3, 60)]), False)
            inner += rng.choice(["<div class=comment><p>{}</p></div>", "<li class=comment><p>{}</p></li>", "<div class=comment-body>{}</div>", "<p>{}</p>"]).format(body)
        return _wrap(rng.choice(COMMENTS), inner)

    def content() -> str:
        n, inner = rng.choice([1, 1, 2, 3, 5, 8, 12, 20]), ""
        if rng.random() < 0.8:
            inner += f"<h1>{t(' '.join(long().split()[: rng.randint(2, 11)]), True)}</h1>"
            if rng.random() < 0.2:
                inner = f"<header>{inner}</header>" if False else inner
        style = rng.random()
        for k in range(n):
            x = long() if rng.random() < 0.75 else " ".join(long().split()[: rng.randint(1, 9)])
            if k and rng.random() < 0.12:
                inner += f"<h{rng.choice('23')}>{t(' '.join(long().split()[:5]), True)}</h2>"
            kind = rng.random()
            if kind < 0.08:
                inner += f"<blockquote>{t(x, True)}</blockquote>"
            elif kind < 0.14:
                inner += "<ul>" + "".join(f"<li>{t(' '.join(long().split()[:8]), True)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>"
            elif kind < 0.17:
                inner += f"<table><tr><td>{t(x, True)}</td><td>{t(' '.join(long().split()[:3]), True)}</td></tr></table>"
            elif style < 0.15:
                inner += f"<div>{t(x, True)}</div>"
            elif style < 0.4:
                inner += f"<p><b>{t(x, True)}<br>" if rng.random() < 0.4 else f"<p>{t(x, True)}"
            else:
                inner += f"<p>{t(x, True)}</p>"
            if rng.random() < 0.06:
                inner += rng.choice([advert, side, notice])()
            if rng.random() < 0.03:
                inner += links(rng.choice(SHARE), 3)
        if rng.random() < 0.15:
            inner += _wrap(rng.choice(SHARE), t(short(), False))
        if rng.random() < 0.08:
            inner += comments()
        return _wrap(rng.choice(CONTENT), inner)

    def footer() -> str:
        inner = raw(rng.choice(FOOTERS).format(rng.choice(["example.org", short()]), " ".join(long().split()[: rng.randint(2, 12)]).replace("<", "")))
        if rng.random() < 0.3:
            inner = f"<p>{inner}</p>" + links("div", rng.randint(2, 5))
        return _wrap(rng.choice(FOOTER), inner)

    page = ""
    for part, chance in ((notice, 0.25), (lambda: _wrap(rng.choice(HEADER), f"<div>{t(short(), False)}</div>" + (links(rng.choice(NAV), rng.randint(2, 6)) if rng.random() < 0.4 else "")), 0.4), (lambda: links(rng.choice(NAV), rng.randint(2, 9)), 0.75), (form, 0.2), (advert, 0.5), (side, 0.2), (content, 0.97), (lambda: links(rng.choice(SHARE), rng.randint(1, 4)), 0.2), (comments, 0.35), (side, 0.3), (advert, 0.2), (form, 0.15), (footer, 0.85), (notice, 0.1)):
        if rng.random() < chance:
            page += part()
    return "<html><body>" + _wrap(rng.choice(PAGE), page) + "</body></html>", marks
