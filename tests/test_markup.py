"""Selectors against a matcher on a tree, JSON against the standard library, and hostile input."""

import json
import random
import time

import pytest

from larder.operators.jsonld import find_recipe, image_of, read_block, steps_of
from larder.operators.jsonread import parse
from larder.operators.pages import read_page
from larder.operators.selectors import Picker, Selectors, extract_by_selectors, pick


class Tree(Picker):
    """Elements as (tag, attributes, ancestors' numbers), as a plain matcher wants them."""

    def __init__(self):
        super().__init__(Selectors(["*"]))
        self.elements, self.path = [], []

    def met(self, lists, tag, attributes):
        del self.path[len(self.open.names) :]
        self.elements.append((tag, attributes, list(self.path)))
        self.path.append(len(self.elements) - 1)


def fits(compound, tag, attributes):
    name, tests = compound
    if name not in ("*", tag):
        return False
    for key, how, wanted in tests:
        if key not in attributes:
            return False
        value = attributes[key]
        if not {"": True, "=": value == wanted, "~=": wanted in value.split(), "*=": wanted in value and wanted != "", "^=": value.startswith(wanted) and wanted != "", "$=": value.endswith(wanted) and wanted != "", "|=": (value + "-").startswith(wanted + "-")}[how]:
            return False
    return True


def matches(chain, elements, number):
    """chain: (combinator, compound) from the last to the first."""
    (how, compound), rest = chain[0], chain[1:]
    tag, attributes, above = elements[number]
    if not fits(compound, tag, attributes):
        return False
    if not rest:
        return True
    return any(matches(rest, elements, a) for a in (above[-1:] if how == ">" else above))


TAGS, NAMES = ["div", "p", "li", "ul", "span", "a"], ["x", "y", "x-y", "ingredient"]


def random_selector(rng):
    text, chain = "", []
    for i in range(rng.randint(1, 4)):
        how = rng.choice([">", " "]) if i else ""
        tag, tests, part = rng.choice([*TAGS, "*"]), [], ""
        part += tag
        for _ in range(rng.randint(0, 2)):
            kind = rng.choice(["class", "id", "attr"])
            value = rng.choice(NAMES)
            if kind == "class":
                part, tests = part + f".{value}", [*tests, ("class", "~=", value)]
            elif kind == "id":
                part, tests = part + f"#{value}", [*tests, ("id", "=", value)]
            else:
                op = rng.choice(["", "=", "~=", "*=", "^=", "$=", "|="])
                key = rng.choice(["class", "id"])
                part, tests = part + (f"[{key}{op}'{value}']" if op else f"[{key}]"), [*tests, (key, op, value if op else "")]
        text += {">": " > ", " ": " ", "": ""}[how] + part
        chain.append((how, (tag, tests)))
    return text, [(h, c) for h, c in reversed(chain)]


def random_page(rng):
    out = []
    for _ in range(rng.randint(1, 40)):
        tag = rng.choice(TAGS)
        if rng.random() < 0.35:
            out.append(f"</{tag}>")
            continue
        attributes = "".join(f' {k}="{" ".join(rng.choices(NAMES, k=rng.randint(1, 2)))}"' for k in ("class", "id") if rng.random() < 0.5)
        out.append(f"<{tag}{attributes}>t{len(out)} ")
    return "".join(out)


def test_selectors_as_on_a_tree():
    rng = random.Random(2)
    for _ in range(300):
        page = random_page(rng)
        tree = Tree()
        tree.read(page)
        everything = tree.texts()[0]
        made = [random_selector(rng) for _ in range(8)]
        got = pick(page, Selectors([text for text, _ in made]))
        for (text, chain), found in zip(made, got, strict=True):
            want = [everything[n] for n in range(len(tree.elements)) if matches(chain, tree.elements, n)]
            assert found == want, (page, text)


def test_selector_syntax():
    page = "<div class='comp mntl x' id=a data-n='true'><p>one<p>two <b>bold</b><ul><li>3<li>4<ul><li>5</ul></ul></div><h1>six</h1><img class=x>"
    one = lambda s: [x.strip() for x in pick(page, Selectors([s]))[0]]
    assert one("p") == ["one", "two bold"] and one("div > p b, h1") == ["bold", "six"] and one("ul > li") == ["3", "45", "5"] and one("li li") == ["5"]
    assert one(".comp.x#a > p") == ["one", "two bold"] and one("[data-n=true] li") == ["3", "45", "5"] and one("[class$='x']") == ["one" + "two bold345", ""]
    assert one("[CLASS~='mntl']") == one(" #a ") == one("DIV") and one("p > p") == [] and one("*.x") == one("[class$=x]")
    for bad in ("", "a:hover", "a + b", "a ~ b", "a >", ", a", "a,,b", "[x", "a[b='c]", "..a", "#", "a > > b"):
        with pytest.raises(ValueError, match="not understood"):
            Selectors([bad])
    assert pick(None, Selectors(["a"])) == [[]]


def test_selectors_in_linear_time():
    for page in ("<div class=x>" * 20_000 + "end", "<ul><li class=x>" * 20_000, "<p><b>" * 20_000, "<td>" * 20_000):
        began = time.thread_time()
        pick(page, Selectors(["div div div div", "div > div.x > div", "li .x", "p > b", "[class*=zzz] x"]))
        assert time.thread_time() - began < 5, page[:9]


def test_selectors_over_rows(spark):
    given = spark.createDataFrame([(1, "<li>a<li>b", "t"), (2, None, "t"), (3, "", "t"), (1, "<ul><li>c</ul>", "t")], "page_id long, html string, texts string")
    got = extract_by_selectors(given, ["li", "ul li"]).select("page_id", "texts").collect()
    assert sorted((r["page_id"], r["texts"]) for r in got) == [(1, [["a", "b"], []]), (1, [["c"], ["c"]]), (2, [[], []]), (3, [[], []])]
    assert extract_by_selectors(given.limit(0), ["li"]).count() == 0


def test_json_is_the_librarys():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randint(0, 8 if depth else 5)
        if kind < 6:
            return [None, True, 'a"\\\né\U0001f600', rng.randint(-(10**20), 10**20), rng.random() * 1e9, ""][kind]
        return [value(depth - 1) for _ in range(rng.randint(0, 4))] if kind == 6 else {rng.choice(["b", "a", "@type", "", "é"]): value(depth - 1) for _ in range(rng.randint(0, 4))}

    for _ in range(2000):
        v = value(4)
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        assert parse(text) == v and repr(parse(text)) == repr(json.loads(text))
        broken = text[: rng.randint(0, len(text))] + rng.choice(["", ",", "}", '"', "\\", "x", "\x01"]) + text[rng.randint(0, len(text)) :]
        try:
            want = json.loads(broken, parse_constant=lambda x: 1 / 0)
        except (ValueError, ZeroDivisionError):
            with pytest.raises(ValueError):
                parse(broken)
        else:
            whole = json.dumps(want, ensure_ascii=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            assert json.dumps(parse(broken), ensure_ascii=False) == whole, broken


def test_json_as_scripts_read_it():
    assert list(parse('{"b":1,"10":2,"9":3,"01":4,"b":5,"4294967295":6,"\\u00b2":7}').items()) == [("9", 3), ("10", 2), ("b", 5), ("01", 4), ("4294967295", 6), ("²", 7)]
    assert parse(r'["\ud800 x", "😀", "\udc00\ud800"]') == ["� x", "\U0001f600", "��"]
    assert parse("1" * 5000) == float("inf") and parse("[1e400]") == [float("inf")]
    for bad in ("", "nul", "[1,]", '{"a":1,}', "{,}", "[", "{", '{"a"', '{"a":', '"', "01", "1.", "NaN", "-", "[1}", '{"a":1]', "﻿1", "1 2", "\xa01", "'a'"):
        with pytest.raises(ValueError):
            parse(bad)


def plain_find(node):
    """The first recipe, by recursion."""
    if isinstance(node, list):
        return next((r for r in map(plain_find, node) if r is not None), None)
    if not isinstance(node, dict):
        return None
    kind = node.get("@type")
    if kind == "Recipe" or isinstance(kind, list) and "recipe" in [str(k).lower() for k in kind] or any(isinstance(node.get(k), (list, dict)) or node.get(k) for k in ("recipeIngredient", "recipeInstructions", "cookTime", "prepTime")):
        return node
    for part in [node.get("@graph") if isinstance(node.get("@graph"), list) else None, *node.values()]:
        if (found := plain_find(part)) is not None:
            return found
    return None


def plain_steps(node):
    if isinstance(node, str):
        return [" ".join(node.split())] if node.strip() else []
    if isinstance(node, list):
        return [s for x in node for s in plain_steps(x)]
    if isinstance(node, dict):
        return (plain_steps(node["itemListElement"]) if node.get("itemListElement") else []) or plain_steps(node.get("text") or node.get("name"))
    return []


def test_recipes_and_steps_as_by_recursion():
    rng = random.Random(6)

    def tree(depth):
        if not depth or rng.random() < 0.3:
            return rng.choice(["a  b", "", None, 3, "Recipe", []])
        if rng.random() < 0.4:
            return [tree(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["@graph", "@type", "x", "y", "text", "name", "itemListElement", "cookTime"] if rng.random() < 0.9 else ["recipeIngredient"]): tree(depth - 1) for _ in range(rng.randint(0, 4))}

    for _ in range(3000):
        node = tree(5)
        assert steps_of(node) == plain_steps(node)
        assert find_recipe(node) is plain_find(node) or find_recipe(node) == plain_find(node)


def timed(limit, f, *args):
    began = time.thread_time()
    out = f(*args)
    assert time.thread_time() - began < limit, args[0][:40]
    return out


def test_json_ld_never_raises_and_is_linear():
    assert read_block('{"@type":"Recipe","name":"\\ud800 pie","recipeIngredient":["\\udfff"]}')[:3] == (True, "� pie", ["�"])
    deep = "[" * 10_000 + '"Boil."' + "]" * 10_000
    assert read_block('{"@type":"Recipe","recipeInstructions":' + deep + "}")[3] == ["Boil."]
    assert read_block('{"@type":"Recipe","recipeIngredient":[' + deep + "]}")[2] in ([""], [deep])
    assert image_of(parse("[" * 5000 + '{"url":"u"}' + "]" * 5000)) == "u"
    graphs = '{"@graph":[' * 3000 + '{"@type":"Recipe","name":"in"}' + "]}" * 3000
    assert timed(2, read_block, graphs)[1] == "in"
    assert timed(2, read_block, '{"@graph":[' * 3000 + "]}" * 3000)[0] is False
    for text in ('{"@type":"Recipe"' * 20_000, '"' * 100_001, '\\"' * 50_000, "[" * 100_000, '{"a":' * 50_000, '{"@type":"Recipe",' + '"x' * 30_000):
        timed(2, read_block, text)
    page = '<script type="application/ld+json">{"@type":"Recipe","name":"a"'
    timed(2, read_page, page * 20_000)
    timed(2, read_page, "<script type=application/ld+json>" * 20_000)
    rng, parts = random.Random(8), ['{"@type":"Recipe"', "{", "}", "[", "]", '"', ":", ",", "\\", "u", "\\ud800", "name", "\n", "1", "e", "recipeIngredient", " "]
    for _ in range(3000):
        read_block("".join(rng.choice(parts) for _ in range(rng.randint(0, 25))))


def test_broken_blocks_are_repaired():
    body = '{"@type":"Recipe","name":"A\nB \\x pie","recipeIngredient":["1 cup"],"recipeInstructions":[{"text":"Mix."}]}'
    assert read_block("var x = [" + body + ",];") == (True, "A B x pie", ["1 cup"], ["Mix."], "")
    assert read_block(body + "}") == (True, "A B x pie", ["1 cup"], ["Mix."], "")
    assert read_block(body[:-1])[0] is False


def test_blocks_of_a_page():
    block = lambda name, kind="application/ld+json": f'<script type="{kind}">{{"@type":"Recipe","name":"{name}","recipeIngredient":["x"]}}</script>'
    page = f"<title>T</title>{block('a')}<body>{block('b', 'text/javascript')}<div>{block('c', 'Application/LD+JSON')}<script type='application/ld+json'> </script><!-- {block('d')} --><p>x</p>{block('&lt;e')}"
    assert [b["name"] for b in read_page(page)["blocks"]] == ["a", "c", "&lt;e"]
    assert [b["name"] for b in read_page(block("a")[:-9])["blocks"]] == ["a"]  # a block that the page's end closes
    assert read_page(None)["blocks"] == [] and read_page("<script type='application/ld+json'>")["blocks"] == []
