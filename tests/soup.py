"""A plain element tree by the standard library's tokenizer, and page fields by walking it: what the expressions are held against."""

import html
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from prospecta.functions.lists import EMAIL
from prospecta.functions.markup import RAW, VOID
from prospecta.operators import pages

CP1252 = {i: bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


class Node:
    def __init__(self, name, attrs, parent):
        self.name, self.parent, self.children = name, parent, []
        self.attrs = {k: v or "" for k, v in attrs}
        self.classes = self.attrs.get("class", "").split()

    def walk(self):
        """All elements below, in order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def strings(self):
        for c in self.children:
            if isinstance(c, Node):
                yield from c.strings()
            elif c is not None:
                yield c

    def text(self, between=" "):
        return between.join(s.strip() for s in self.strings() if s.strip())

    def siblings(self):
        every = [c for c in self.parent.children if isinstance(c, Node)]
        return every[every.index(self) + 1 :]

    def within(self, name):
        up = self.parent
        while up:
            if name in up.classes:
                return True
            up = up.parent
        return False


class Tree(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.root = Node("", [], None)
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs, ends=False):
        node = Node(tag, attrs, self.open[-1])
        self.open[-1].children.append(node)
        if not ends and tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        self.open[-1].children.append(None)  # texts before and after stay apart, even if nothing is closed
        if tag in [n.name for n in self.open[1:]]:
            while self.open.pop().name != tag:
                pass

    def _add(self, text):
        if self.open[-1].name in RAW:
            return
        held = self.open[-1].children
        if held and isinstance(held[-1], str):
            held[-1] += text
        else:
            held.append(text)

    def handle_data(self, data):
        self._add(data)

    def handle_comment(self, data):
        self.open[-1].children.append(None)

    handle_decl = handle_pi = unknown_decl = handle_comment

    def handle_charref(self, name):
        n = int(name[1:], 16) if name[0] in "xX" else int(name)
        self._add(CP1252.get(n) or ("�" if not 0 < n <= 0x10FFFF or 0xD800 <= n < 0xE000 else chr(n)))

    def handle_entityref(self, name):
        self._add(html.entities.html5.get(name + ";") or html.entities.html5.get(name) or "&" + name)


def tidy(text):
    return re.sub(r"\s+", " ", text).strip()


def fields(page, url):
    """The nine fields by walking the tree, place by place."""
    every = list(Tree(page).root.walk())
    flat = pages.FLAT_DOMAIN in url.split("/")[2] if "//" in url else False
    find = lambda test: next((e for e in every if test(e)), None)
    said = lambda e, between=" ": e.text(between) if e else ""
    of = lambda c: lambda e: c in e.classes
    out = dict.fromkeys(pages.FIELDS, "")

    heads = [find(lambda e, n=n: e.name == n) for n in ("h1", "h2")]
    out["name"] = said(heads[0]) if flat or heads[0] else said(heads[1])
    if not out["name"] and not flat:
        out["name"] = said(next((e for c in pages.NAME_CLASSES if (e := find(of(c)))), None))

    item = find(lambda e: e.name == "li" and e.within("profile__titles"))
    out["title"] = said(item) if flat or item else said(find(of("profile__titles")))
    if not out["title"] and not flat:
        tests = [lambda e: "title" in e.classes and e.within("main-profile-info"), lambda e: e.name == "h2" and e.within("main-profile-info"), lambda e: "title" in e.classes and e.within("profile-header"), *[of(c) for c in pages.TITLE_CLASSES]]
        out["title"] = next((t for test in tests if (e := find(test)) and re.search(pages.TITLE_WORDS, t := said(e)) and len(t) < 200), "")

    lab = ""
    for li in (e for e in every if e.name == "li" and e.within("profile__contact")):
        label = next((e.text("") for e in li.walk() if "profile__contact-label" in e.classes), "")
        value = li.text("").replace(label, "").strip() if label else li.text("")
        links = [e.attrs["href"] for e in li.walk() if e.name == "a" and "href" in e.attrs]
        low = label.lower()
        if "email" in low:
            mail = next((h for h in links if h.lower().startswith("mailto:")), None)
            if mail is not None:
                out["email"] = mail.replace("mailto:", "").strip()
            elif not out["email"] and (m := re.search(EMAIL, value)):
                out["email"] = m.group()
        elif "phone" in low:
            out["phone"] = value
        elif "office" in low:
            out["office"] = value
        elif not low or (not flat and "website" in low):
            site = next((h for h in links if h.lower().startswith("http")), None)
            if site and pages.OWN_DOMAIN not in site and "scholar.google" not in site:
                lab = site
    anchors = [e for e in every if e.name == "a" and "href" in e.attrs]
    if not flat:
        starts = lambda word: next((e.attrs["href"] for e in anchors if e.attrs["href"].lower().startswith(word)), "")
        out["email"] = out["email"] or starts("mailto:").replace("mailto:", "").strip().rstrip(".")
        for c in pages.CONTACT_CLASSES:
            if not out["email"] and (e := find(of(c))) and (m := re.search(EMAIL, "".join(e.strings()))):
                out["email"] = m.group()
        out["phone"] = out["phone"] or starts("tel:").replace("tel:", "").strip()
        if not out["office"]:
            out["office"] = said(next((e for c in pages.OFFICE_CLASSES if (e := find(of(c)))), None))
        if not out["office"]:
            out["office"] = said(next((n[0] for e in every if e.name in ("dt", "strong", "b") and re.search("(?i)office|location", e.text("")) and (n := e.siblings())), None))

    for e in anchors if not lab else []:
        href, t = e.attrs["href"], e.text("")
        if not href or href.startswith(("mailto:", "#")) or any(s in href.lower() for s in pages.SOCIAL):
            continue
        if re.search(pages.LAB_WORDS, t) or (not flat and href.startswith("http") and pages.OWN_DOMAIN not in href and re.search("lab|group|research", t.lower())):
            lab = href if href.startswith("http") else urljoin(url, href)
            break
    out["lab_website"] = lab
    out["google_scholar"] = next((e.attrs["href"] for e in anchors if "scholar.google.com" in e.attrs["href"]), "")

    boxed = lambda c: (e.attrs.get("src", "") if (e := find(lambda e: e.name == "img" and e.within(c))) else "")
    if flat:
        src = boxed("profile__image") or boxed("profile")
    else:
        own = e.attrs.get("src", "") if (e := find(lambda e: e.name == "img" and "profile" in e.classes)) else ""
        src = next((s for s in (*map(boxed, pages.PHOTO_CLASSES), own) if s and "facebook.com" not in s and not s.endswith(".svg")), "")
    out["photo_url"] = urljoin(url, src) if src else ""
    out["research_summary"] = summary(every, find)
    return out


def section(heading):
    parts = []
    for e in heading.siblings():
        if re.fullmatch("h[1-6]", e.name):
            break
        parts.append(" | ".join(t for li in e.walk() if li.name == "li" and (t := li.text())) if e.name in ("ul", "ol") else e.text())
        if sum(map(len, parts)) > 1200:
            break
    return tidy(" ".join(parts))


def summary(every, find):
    for e in every:
        if e.name in ("h2", "h3", "h4", "h5", "strong", "b") and re.fullmatch(f"(?i)(?:{pages.RESEARCH_HEADING})", e.text("")) and (text := section(e)):
            return text
    for word in pages.RESEARCH_NAMES:
        e = find(lambda e, w=word: w in e.attrs.get("id", "").lower()) or find(lambda e, w=word: any(w in c.lower() for c in e.classes))
        if e:
            if text := tidy(e.text())[:1200]:
                return text.strip()
            break
    text = ""
    for word in pages.BODY_CLASSES:
        if e := find(lambda e, w=word: any(w in c.lower() for c in e.classes)):
            text = tidy(e.text())[:1200]
            if len(text) > 80:
                break
    if not text:
        text = max((tidy(e.text()) for e in every if e.name == "p" and len(e.text("")) > 100), key=len, default="")[:1200]
    return text.strip()
