"""Blocks with brackets and by indentation, and the facts that rest on them."""

from ledgerlens.operators import blocks, facts
from ledgerlens.plans import audit

FILES = "repo_id string, path string, content string"


def tree(spark, **files):
    names = {k: k.replace("__", "/").replace("_DOT_", ".") for k in files}
    return spark.createDataFrame([("r", names[k], c) for k, c in files.items()], FILES)


def braced(spark, path, text):
    df = spark.createDataFrame([("r", path, text)], FILES)
    return [(r.kind, r.head.strip(), r.body) for r in blocks.braced(df).orderBy("place").collect()]


def test_nested_functions_of_scripts(spark):
    text = """export async function outer(a = '}', { b }) {
  const f = async (x) => { return () => { x } }
  try { f() } catch { /* { */ } finally { }
  if (a) { while (b) { } }
}
class A { get name(): string { return `{${this.n}` } static m<T>(x: T) { return x.replace(/[{"]/g, '') } }
list.map(y => { y })
// function no() {
"""
    got = braced(spark, "a.ts", text)
    assert [(k, h) for k, h, _ in got] == [
        ("function", "async function outer(a = '}', { b }) {"), ("arrow", "async (x) => {"), ("arrow", "() => {"), ("catch", "catch {"),
        ("method", "name(): string {"), ("method", "m<T>(x: T) {"), ("arrow", "y => {"),
    ]
    assert [b for _, _, b in got][1:] == [" return () => { x } ", " x ", " /* { */ ", " return `{${this.n}` ", " return x.replace(/[{\"]/g, '') ", " y "]
    assert braced(spark, "open.ts", "function f() { if (x) {") == [] and braced(spark, "x.ts", "}} function g() { }")[0][2] == " "
    assert braced(spark, "none.ts", None) == [] and braced(spark, "empty.ts", "") == []


def test_functions_of_go_and_rust(spark):
    go = "func (s *S) Run(f func(int) error) (int, error) {\n\tgo func() { s.x = `{` }()\n\treturn 1, nil\n}\n"
    assert [(k, b) for k, _, b in braced(spark, "a.go", go)] == [("function", "\n\tgo func() { s.x = `{` }()\n\treturn 1, nil\n"), ("function", " s.x = `{` ")]
    rust = "impl<'a> T<'a> { fn f(&'a self, c: char) -> &'a str { if c == '{' { \"}\" } else { self.s } } }\nfn g<T>(x: T) where T: Copy { x }"
    assert [b for _, _, b in braced(spark, "a.rs", rust)] == [" if c == '{' { \"}\" } else { self.s } ", " x "]


def test_calls_over_lines(spark):
    df = tree(spark, a_DOT_ts="app.post('/x', (req, res) => {\n  if (a) { b(req.user) }\n})\nlog(')')\n")
    assert [r.body for r in blocks.called(df, r"\bapp\.post\(").collect()] == ["'/x', (req, res) => {\n  if (a) { b(req.user) }\n}"]


def test_blocks_of_python(spark):
    text = '''def a(
    x,
) -> int:
    """doc
not the end
"""
    def inner():
        return 1

    # a comment
# another
    return inner()
class T:
    async def test_b(self): pass
x = 1
'''
    df = tree(spark, a_DOT_py=text)
    got = {r.head.strip(): r.body for r in blocks.indented(df, r"^\s*(?:async\s+)?def\s").collect()}
    assert set(got) == {"def a(", "def inner():", "async def test_b(self): pass"}
    assert got["def inner():"].strip() == "return 1\n\n    # a comment\n# another" and got["async def test_b(self): pass"] == ""
    assert got["def a("].rstrip().endswith("return inner()")


def test_handler_kinds(spark):
    js = {
        "": "empty", "/* expected */": "documented", "log.error(e)": "log-only", "winston.error(e); pino(e)": "log-only", "logger.warn(`x ${f(e)}`);\n console.log(e)": "log-only",
        "log.error(e); throw e": "handled", "return null": "handled", "console.error(e) // told": "log-only", "const log = 1": "handled", "await log(e)": "handled",
    }
    rows = [("r", f"{i}.ts", "try {} catch (e) {" + b + "\n}") for i, b in enumerate(js)]
    rows += [("r", "u.ts", "try {} catch (_err) {}"), ("r", "t.ts", "try {} catch (_e: unknown) { }")]
    py = {
        "pass": "empty", "...": "empty", "# fine\n        pass": "documented", "logging.error(\n            e)\n        print(e)": "log-only", "log.exception('x # y')": "log-only",
        "raise": "handled", "logger.info(e)\n        return": "handled", "pass  # why": "documented",
    }
    rows += [("r", f"{i}.py", f"def f():\n    try:\n        x()\n    except (A, B) as e:\n        {b}\n    return 1\n") for i, b in enumerate(py)]
    rows += [("r", "one.py", "try: x()\nexcept: pass\n")]
    got = {r.path: r.kind for r in facts.handlers(spark.createDataFrame(rows, FILES)).collect()}
    want = {f"{i}.ts": k for i, k in enumerate(js.values())} | {"u.ts": "documented", "t.ts": "documented", "one.py": "empty"} | {f"{i}.py": k for i, k in enumerate(py.values())}
    assert got == want


def test_cases_of_python(spark):
    text = "class T(TestCase):\n    def test_a(self):\n        assert x, 'assert y'\n        self.assertEqual(1, 2)\n        m.assert_called_once()\n    def helper(self):\n        assert 1\n    async def testB(self):\n        with raises(E):\n            f()\n\ndef test_c(): assert True\n"
    got = {r.name: (r.assertions, r.mock_only) for r in facts.test_cases(tree(spark, tests__test_a_DOT_py=text, src__a_DOT_py=text)).collect()}
    assert got == {"test_a": (3, 1), "testB": (0, 0), "test_c": (1, 0)}


def test_comments_and_the_code_near_them(spark):
    js = (
        "// load user data\n\n  \nconst loadUserData = 1\n"  # blank lines between
        "// first line\n// second load\nload()\n"  # the first one stands above a comment
        "const total = sum(items) // sum total items\n"  # behind code
        "const url = 'http://x // y'\n"
        "/* parse input */\nparse(input)\n"
        "// webpackChunkName: load\nload()\n// at the end\n\n"
    )
    got = {(r.line, r.text, r.hit) for r in facts.comments(tree(spark, src__a_DOT_ts=js)).collect()}
    assert got == {(1, "load user data", True), (6, "second load", False), (8, "sum total items", True), (10, "parse input", True)}
    py = "# count rows\n\nrows = count()\nx = '#no' # set x\n"
    assert {(r.line, r.hit) for r in facts.comments(tree(spark, a_DOT_py=py)).collect()} == {(1, True), (4, False)}


def test_copies_among_nested_functions(spark):
    body = "{ const total = items.map(i => i.price * i.count).filter(Boolean); let sum = 0; for (const t of total) sum += t; return sum / total.length }"
    files = tree(
        spark, src__a_DOT_ts=f"class A {{ average(items) {body} }}\n", src__b_DOT_ts="const f = (goods) => " + body.replace("items", "goods").replace("sum", "all") + "\n",
        src__c_DOT_ts="function outer() { function inner(things) " + body.replace("items", "things") + "\n return inner }\n",
    )
    assert sorted(r.n for r in audit.clone_families(files).collect()) == [1, 3]
