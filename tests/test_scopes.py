"""Scopes of Python and of braced sources, against the abstract syntax tree and by hand."""

import ast
import random

from tidemark.operators import scopes

JS = """class Widget extends Base {
  constructor(a) { this.a = a }
  async render(x) {
    if (x) { return "}" }
    const f = (y) => {
      return y // }
    }
  }
}
function outer(
  a,
  b) {
  return { a: 1 }
}
declare function none(x): void;
const later = async v => {
  for (const x of v) {
  } 
}
function open() {
"""


def tree_scopes(source):
    out = []

    def walk(node, inside):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside else "function"
                out.append((child.name, kind, child.lineno, child.end_lineno))
                walk(child, kind == "class")
            else:
                walk(child, False if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)) else inside)

    walk(ast.parse(source), False)
    return sorted(out)


def python_source(draw):
    lines = []

    def block(depth):
        for _ in range(draw.randrange(1, 5)):
            pad = "    " * depth
            kind = draw.randrange(7)
            if kind < 3 and depth < 5:
                lines.append(pad + draw.choice(["def f{}(x):", "async def g{}(", "class C{}(Base):", "class D{}:"]).format(len(lines)))
                if lines[-1].endswith("("):
                    lines[-1] += "x, y):  # ("
                block(depth + 1)
                continue
            lines.append(pad + draw.choice(["x = 1", "s = 'def no(): #'", "if x: pass", "return_ = '''t'''"]))
            if draw.random() < 0.3:
                lines.append(draw.choice(["", "   ", "# at the edge", pad + "# inside"]))

    block(0)
    while lines and (not lines[-1].strip() or lines[-1].strip().startswith("#")):
        lines.pop()
    return "\n".join(lines)


def test_scopes(spark):
    draw = random.Random(8)
    sources = {f"p{k}.py": python_source(draw) for k in range(40)} | {"a.js": JS, "n.txt": "def x():\n  y", "e.py": ""}
    lines = spark.createDataFrame([(p, n, x) for p, s in sources.items() for n, x in enumerate(s.split("\n"), 1)] + [("e.py", 2, None)], "path string, line_no long, line string").repartition(6)
    got = {}
    for r in scopes.scopes(lines).collect():
        got.setdefault(r["path"], []).append((r["name"], r["kind"], r["first"], r["last"]))
    for p, s in sources.items():
        if p.endswith(".py"):
            assert sorted(got.get(p, [])) == tree_scopes(s), p
    assert sorted(got["a.js"]) == sorted([("Widget", "class", 1, 9), ("constructor", "method", 2, 2), ("render", "method", 3, 8), ("f", "function", 5, 7), ("outer", "function", 10, 14), ("later", "function", 16, 19)])
    assert "n.txt" not in got and scopes.scopes(lines.limit(0)).count() == 0


def test_enclosing_and_body(spark):
    found = spark.createDataFrame([("a", "C", "class", 1, 500), ("a", "f", "method", 10, 400), ("a", "g", "function", 100, 110), ("b", "D", "class", 1, 3)], scopes.SCOPES)
    hits = spark.createDataFrame([("a", 105, 1), ("a", 200, 1), ("a", 5, 2), ("a", 600, 1), ("b", 2, 1), ("c", 1, 1)], "path string, line_no long, query int")
    names = lambda mode: {(r["path"], r["line_no"]): r["scope"] and r["scope"]["name"] for r in scopes.enclosing(hits, found, mode).collect()}
    assert names("function") == {("a", 105): "g", ("a", 200): "f", ("a", 5): "C", ("a", 600): None, ("b", 2): "D", ("c", 1): None}
    assert names("class") == {("a", 105): "C", ("a", 200): "C", ("a", 5): "C", ("a", 600): None, ("b", 2): "D", ("c", 1): None}
    lines = spark.createDataFrame([(p, n, f"l{n}") for p in "ab" for n in range(1, 501)], "path string, line_no long, line string")
    rows = {(r["path"], r["line_no"]): (r["body"], r["truncated"], r["place"]) for r in scopes.with_body(scopes.enclosing(hits, found), lines).collect()}
    assert rows["a", 105] == ([f"l{n}" for n in range(100, 111)], False, 5) and rows["a", 600] == (None, None, None)
    assert rows["a", 200] == ([f"l{n}" for n in range(10, 210)], True, 190) and rows["b", 2] == (["l1", "l2", "l3"], False, 1)
