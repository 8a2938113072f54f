"""HTML in one pass: marks around entities in its text."""

from __future__ import annotations

import re
from html import escape
from html.parser import HTMLParser

#: Inline tags that only present, and would cut a name in two; elements whose text is left alone.
UNWRAPPED, PROTECTED = ("em", "strong", "i", "b"), ("code", "script", "style")
#: What a species is known by, shown as data attributes.
SPECIES_DATA = ("accepted_scientific_name", "scientific_name_verified", "common_name", "name_type", "taxon_id", "source_db", "source_url")


class Highlighter(HTMLParser):
    """Writes HTML again with the entities in its text nodes marked.

    Presenting tags go first, so that a name may run over them.  Tags, comments and
    declarations stay as they stand; text is decoded, matched and encoded again; text in
    protected elements and in existing marks is passed on as it is.
    """

    def __init__(self, entities: list[tuple[str, str, dict]]):
        """``entities``: (text, label, data); longer texts first, of equal texts the first label by name."""
        super().__init__(convert_charrefs=True)
        known: dict[str, tuple[str, dict]] = {}
        for text, label, data in sorted(entities, key=lambda x: (x[0].lower(), x[1])):
            if text:
                known.setdefault(text.lower(), (label, data or {}))
        self.known = known
        texts = sorted(known, key=lambda t: (-len(t), t))
        self.pattern = re.compile("|".join(rf"\b{re.escape(t)}\b" for t in texts), re.IGNORECASE) if texts else None

    def mark(self, html: str) -> str:
        self.reset()
        self.out: list[str] = []
        self.text: list[str] = []
        self.inside: list[str] = []  # protected elements that are open
        self.spans: list[bool] = []  # of the spans that are open, whether each is a mark
        self.feed(html)
        self.close()
        self._flush()
        return "".join(self.out)

    def _flush(self) -> None:
        text = "".join(self.text)
        self.text.clear()
        if self.pattern is None or not text.strip():
            self.out.append(escape(text, quote=False))
            return
        last = 0
        for m in self.pattern.finditer(text):
            self.out += [escape(text[last : m.start()], quote=False), self._span(m[0])]
            last = m.end()
        self.out.append(escape(text[last:], quote=False))

    def _span(self, text: str) -> str:
        label, data = self.known.get(text.lower(), ("ENTITY", {}))
        name = re.sub("[^a-z]+", "-", label.lower())
        more = "".join(f' data-{k.replace("_", "-")}="{escape(str(data[k]))}"' for k in SPECIES_DATA if data.get(k)) if label == "SPECIES" else ""
        return f'<span class="ent-{name}"{more}>{escape(text, quote=False)}</span>'

    def _raw(self, text: str) -> None:
        self._flush()
        self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in UNWRAPPED and not self.inside:
            return
        self._raw(self.get_starttag_text())
        if tag in PROTECTED:
            self.inside.append(tag)
        elif tag == "span":
            self.spans.append(any(c.startswith("ent-") for c in (dict(attrs).get("class") or "").split()))

    def handle_startendtag(self, tag, attrs):
        if tag not in UNWRAPPED or self.inside:
            self._raw(self.get_starttag_text())

    def handle_endtag(self, tag):
        if tag in UNWRAPPED and not self.inside:
            return
        self._raw(f"</{tag}>")
        if self.inside and self.inside[-1] == tag:
            self.inside.pop()
        elif tag == "span" and self.spans:
            self.spans.pop()

    def handle_data(self, data):
        if self.inside or any(self.spans):
            raw = self.inside and self.inside[-1] in self.CDATA_CONTENT_ELEMENTS
            self._raw(data if raw else escape(data, quote=False))
        else:
            self.text.append(data)

    def handle_comment(self, data):
        self._raw(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._raw(f"<!{decl}>")

    def unknown_decl(self, data):
        self._raw(f"<![{data}]>")

    def handle_pi(self, data):
        self._raw(f"<?{data}>")
