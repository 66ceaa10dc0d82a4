"""Reads one stored page: a small element tree and the selectors jobs need.

Helper of ``captures``; runs inside Arrow batches. Selectors may use a tag,
classes, ``[attr]``, ``[attr="v"]``, ``[attr*="v"]`` with the ``i`` flag,
descendant spaces and comma lists.
"""

import re
from bisect import bisect_right
from html.parser import HTMLParser

VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNSEEN_TAGS = frozenset("head script style noscript template title".split())

_STEP = re.compile(
    r"""(?P<tag>^[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)
    |\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)"(?P<val>[^"]*)"(?P<fold>\s+i)?)?\]""",
    re.VERBOSE,
)
_SPACES = re.compile(r"\s+")
_JS_SPACE = " \t\n\r\v\f\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(
    map(chr, range(0x2000, 0x200B))
)


class Element:
    """``index`` counts elements in document order, ``last`` ends the subtree."""

    __slots__ = ("tag", "attrs", "parent", "children", "index", "last", "page")

    def __init__(self, tag, attrs, parent, index, page):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.index = self.last = index
        self.page = page

    def text(self, skipped=frozenset()):
        out, stack = [], list(reversed(self.children))
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skipped:
                stack.extend(reversed(node.children))
        return "".join(out)


class ElementIndex:
    """Elements of a page in document order, and where looked-up keys occur."""

    def __init__(self, keys):
        self.elements = []
        self.places = {"tag": {}, "attr": {}, "class": {}}
        for kind, name in keys:
            self.places[kind][name] = []
        self.tags, self.attrs, self.classes = self.places.values()

    def add(self, node):
        node.index = node.last = at = len(self.elements)
        self.elements.append(node)
        if node.tag in self.tags:
            self.tags[node.tag].append(at)
        for name in node.attrs:
            if name in self.attrs:
                self.attrs[name].append(at)
            if name == "class" and self.classes:
                for cls in set(node.attrs[name].split()):
                    if cls in self.classes:
                        self.classes[cls].append(at)

    def close(self):
        for node in reversed(self.elements):
            node.parent.last = max(node.parent.last, node.last)

    def inside(self, scope, key):
        kind, name = key
        found = self.places[kind][name]
        return found[bisect_right(found, scope.index) : bisect_right(found, scope.last)]


class _TreeBuilder(HTMLParser):
    def __init__(self, keys):
        super().__init__(convert_charrefs=True)
        self.page = ElementIndex(keys)
        self.root = self.open = Element("", {}, None, -1, self.page)

    def _append(self, tag, attrs):
        known = {k: v or "" for k, v in reversed(attrs)} if attrs else {}
        node = Element(tag, known, self.open, 0, self.page)
        self.open.children.append(node)
        self.page.add(node)
        return node

    def handle_starttag(self, tag, attrs):
        node = self._append(tag, attrs)
        if tag not in VOID_TAGS:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self._append(tag, attrs)

    def handle_endtag(self, tag):
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html, keys=()):
    """Element tree; ``keys`` are the lookups of the selectors it will be asked for."""
    builder = _TreeBuilder(keys)
    try:
        builder.feed(html or "")
        builder.close()
    except AssertionError:  # broken declaration: keep the tree read so far
        pass
    builder.page.close()
    return builder.root


def _compile_step(text):
    tests, end = [], 0
    for m in _STEP.finditer(text):
        if m.start() != end:
            break
        end = m.end()
        tests.append((m["tag"], m["cls"], m["attr"], m["op"], m["val"], bool(m["fold"])))
    if end != len(text):
        raise ValueError(f"unsupported selector: {text!r}")
    return tests


def compile_selector(selector):
    """Alternatives of descendant steps, last step first."""
    outside_brackets = r"(?![^\[]*\])"
    return [
        [_compile_step(s) for s in reversed(re.split(rf"\s+{outside_brackets}", alt.strip()))]
        for alt in re.split(rf",{outside_brackets}", selector)
    ]


def _fits(node, tests):
    for tag, cls, attr, op, val, fold in tests:
        if tag is not None:
            if node.tag != tag:
                return False
        elif cls is not None:
            if cls not in node.attrs.get("class", "").split():
                return False
        else:
            have = node.attrs.get(attr)
            if have is None:
                return False
            if op is not None:
                want = val
                if fold:
                    have, want = have.lower(), want.lower()
                if not (have == want if op == "=" else want in have):
                    return False
    return True


def _matches(node, steps):
    if not _fits(node, steps[0]):
        return False
    up = node.parent
    for tests in steps[1:]:
        while up is not None and not _fits(up, tests):
            up = up.parent
        if up is None:
            return False
        up = up.parent
    return True


def _rarest_key(tests):
    """What to look the step up by: a class, else an attribute, else the tag."""
    for tag, cls, attr, *_ in tests:
        if cls is not None:
            return ("class", cls)
    for tag, cls, attr, *_ in tests:
        if attr is not None:
            return ("attr", attr)
    return ("tag", tests[0][0])


def lookup_keys(selectors):
    return {_rarest_key(steps[0]) for compiled in selectors for steps in compiled}


def find_all(scope, compiled):
    """Matching elements below ``scope`` in document order."""
    found = set()
    elements = scope.page.elements
    for steps in compiled:
        for i in scope.page.inside(scope, _rarest_key(steps[0])):
            if _matches(elements[i], steps):
                found.add(i)
    return [elements[i] for i in sorted(found)]


def find(scope, compiled):
    return next(iter(find_all(scope, compiled)), None)


def clean(node):
    return None if node is None else node.text().strip(_JS_SPACE)


def visible_text(root):
    """Text of the page without unrendered elements, white space collapsed."""
    return _SPACES.sub(" ", root.text(UNSEEN_TAGS)).strip()


def read_card(card, sel, names):
    """Raw texts of one review card. ``names`` holds the attribute names."""

    def attr(node, name):
        return None if node is None else node.attrs.get(name)

    box = find(card, sel["time_container"])
    response = find(card, sel["response_container"])
    return {
        "review_id": attr(find(card, sel["review_id"]), names["review_id_attr"]) or "",
        "author": clean(find(card, sel["author_name"])),
        "author_url": attr(find(card, sel["author_button"]), names["author_url_attr"]),
        "stars_label": attr(find(card, sel["stars"]), names["stars_attr"]),
        "publish_time": clean(find(box, sel["time"])) if box else None,
        "text": clean(find(card, sel["text"])),
        "photos": len(find_all(card, sel["photo"])),
        "owner_response_text": clean(find(response, sel["response_text"])) if response else None,
        "owner_response_time": clean(find(response, sel["response_time"])) if response else None,
    }


class Page:
    """Fields of one page, each a method, so that only wanted ones cost time."""

    def __init__(self, html, sel, names, keys, snippet_chars, sign_in_text):
        self.root = parse(html, keys)
        self.sel, self.names = sel, names
        self.snippet_chars, self.sign_in_text = snippet_chars, sign_in_text
        self._body = None

    def name(self):
        return clean(find(self.root, self.sel["name"]))

    def address(self):
        return clean(find(self.root, self.sel["address"]))

    def rating_text(self):
        label = find(self.root, self.sel["rating_label"])
        text = label.attrs.get("aria-label") if label else None
        if text:
            return text
        spans = (clean(n) for n in find_all(self.root, self.sel["rating_span"]))
        return next((t for t in spans if re.fullmatch(r"[0-9]\.[0-9]", t)), None)

    def tab_text(self):
        tabs = (clean(n) for n in find_all(self.root, self.sel["tab"]))
        return next((t for t in tabs if "review" in t.lower()), None)

    def badge_text(self):
        main = find(self.root, self.sel["main_region"])
        badge = find(main, self.sel["review_badge"]) if main else None
        return badge.attrs.get("aria-label") if badge else None

    def body_snippet(self):
        main = find(self.root, self.sel["main_region"])
        return clean(main)[: self.snippet_chars] if main else None

    def body_text(self):
        if self._body is None:
            self._body = visible_text(self.root)
        return self._body

    def body_chars(self):
        return len(self.body_text())

    def sort_text(self):
        return clean(find(self.root, self.sel["sort_region"]))

    def loading(self):
        return find(self.root, self.sel["loading"]) is not None

    def asks_sign_in(self):
        return find(self.root, self.sel["sign_in_label"]) is not None or any(
            self.sign_in_text in _SPACES.sub(" ", n.text()).lower()
            for n in find_all(self.root, self.sel["sign_in_text"])
        )

    def cards(self):
        return [
            read_card(c, self.sel, self.names) for c in find_all(self.root, self.sel["review_card"])
        ]
