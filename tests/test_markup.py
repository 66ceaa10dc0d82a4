from placelens import fixed_values as V
from placelens.operators.markup import Page, clean, compile_selector, find, find_all, lookup_keys, parse, visible_text

NAMES = {k: v for k, v in V.DEFAULT_SELECTORS.items() if k.endswith("_attr")}
COMPILED = {k: compile_selector(v) for k, v in V.DEFAULT_SELECTORS.items() if k not in NAMES}


def page(html):
    return Page(html, COMPILED, NAMES, lookup_keys(COMPILED.values()), 10, "sign in")


def texts(html, selector):
    compiled = compile_selector(selector)
    return [clean(n) for n in find_all(parse(html, lookup_keys([compiled])), compiled)]


def test_selectors():
    html = '<div class="a b" x="Y z"><p class=c>1</p><span><p class="c d">2</p></span></div><p class=c>3</p>'
    assert texts(html, "p.c") == ["1", "2", "3"]
    assert texts(html, "div p") == ["1", "2"]
    assert texts(html, "div.a.b span .d") == ["2"]
    assert texts(html, '[x*="y z" i]') == ["12"]
    assert texts(html, '[x*="y z"]') == []
    assert texts(html, '[x="Y z"] p, p.c') == ["1", "2", "3"]
    assert texts(html, "div p, .none") == ["1", "2"]
    assert texts(html, "p div") == []


def test_unclosed_void_and_broken_markup():
    paragraph = compile_selector("p")
    root = parse("<div><p>a<br>b<img src=x>c</div></b>d<!-- e --><script>f</script>", lookup_keys([paragraph]))
    assert visible_text(root) == "abcd"
    assert clean(find(root, paragraph)) == "abc"
    assert parse("<![foo <div>").text() is not None
    assert visible_text(parse(None)) == ""


def test_first_attribute_wins_and_entities_decode():
    assert texts('<a id="1" id="2">x &amp; y</a>', '[id="1"]') == ["x & y"]


CARD = (
    '<div class="jftiEf"><span data-review-id="{id}"></span>{author}'
    '<button data-href="https://e.org/contrib/9"></button>{stars}<span class="rsqaWe">not this</span>'
    '<div class="DU9Pgb"><span class="rsqaWe"> 2 days ago </span></div>{text}'
    '<button class="Tya61d"></button><button class="Tya61d x"></button>{response}</div>'
)


def test_cards():
    full = CARD.format(
        id="r1", author='<div class="d4r55"> Ann  B </div>',
        stars='<span class="kvMYJc" role="img" aria-label="4 stars"></span>',
        text='<div class="MyEned"><span class="wiI7pd"> Good <i>food</i></span></div>',
        response='<div class="CDe7pd"><div class="wiI7pd">Thanks</div><span class="DZSIDd">now</span></div>',
    )
    bare = CARD.format(id="", author="", stars="", text='<div class="wiI7pd">a div is no body</div>', response="")
    got = page(f"<html><body>{full}{bare}</body></html>").cards()
    assert got[0] == {
        "review_id": "r1", "author": "Ann  B", "author_url": "https://e.org/contrib/9", "stars_label": "4 stars",
        "publish_time": "2 days ago", "text": "Good food", "photos": 2, "owner_response_text": "Thanks",
        "owner_response_time": "now",
    }
    assert got[1]["review_id"] == "" and got[1]["author"] is None and got[1]["text"] is None
    assert got[1]["owner_response_text"] is None


def test_header_sources():
    p = page(
        '<h1> Gym </h1><span aria-hidden="true">4.2</span><button role="tab">Menu</button>'
        '<button role="tab"> REVIEWS 5 </button><b aria-label="9 reviews outside"></b>'
        '<div role="main">0123456789abc<i aria-label="7 Reviews"></i></div>'
        '<button data-item-id="address"><div class="fontBodyMedium"> 1 St </div></button>'
    )
    assert (p.name(), p.rating_text(), p.tab_text(), p.badge_text()) == ("Gym", "4.2", "REVIEWS 5", "7 Reviews")
    assert (p.body_snippet(), p.address()) == ("0123456789", "1 St")
    labelled = page('<i role="img" aria-label="3 stars"></i><span aria-hidden="true">4.2</span>')
    assert labelled.rating_text() == "3 stars"
    empty = page("<h1></h1>")
    assert empty.name() == "" and page("<p>").name() is None
    assert (empty.tab_text(), empty.badge_text(), empty.body_snippet()) == (None, None, None)


def test_flags():
    assert page('<div class="lXJj5c"></div>').loading() and not page("<div></div>").loading()
    assert page("<a>Please <b>SIGN</b>\n in</a>").asks_sign_in()
    assert page('<a aria-label="Sign in"></a>').asks_sign_in()
    assert not page("<p>Sign in</p>").asks_sign_in()
    assert page('<div aria-live="polite" aria-atomic="true">Now lowest</div>').sort_text() == "Now lowest"
    assert page("<body>a\n\n b<style>x</style></body>").body_chars() == 3
