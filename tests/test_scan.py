import random
import time
import tracemalloc

import pytest

from quillgraph.sources import scan

SCRIPT = [
    "export function f%d() { g(); h.x(); }\n", "import { a as b, c } from './m%d';\n", "import * as ns from \"./n%d\"\n", "const é%d = { a: 1, b: `t ${ f({}) } x` }\n", "function }{ bad%d(\n", "import x%d\n",
    "export class C%d<T> extends B<T> implements I, J<{a: string; b: number}> { m(x: T): void { this.y(); } static async k() { return new Foo(1); } }\n", "for (let i = 0; i < n%d; i++) { g<T>(i); }\n",
    "interface I%d extends K { a(): void }\n", "type T%d = { a: string }\n", "// comment } %d\n", "declare function df%d(): void\n", "x = /re[/]g%d/g.test(y)\n", "a.b().c(%d)\n",
]
PYTHON = [
    "def f%d(x):\n    return g(x)\n", "@deco\ndef d%d():\n    s = '''\ndef no():\n  pass\n'''\n    return s.x()\n", "class C%d(B, D):\n    async def m(self):\n        return self.é()\n", "x%d = '''\nclass A:\n    pass\n'''\n",
    "from . import a%d, b as c\n", "if x%d:\n    def inner(): pass\nelse:\n    y = h()\n", "y = (\n1,\n%d)\n", "z = 1 \\\n  + f(%d)\n", "\r\ndef crlf%d():\r\n    return k()\r\n",
]


@pytest.mark.parametrize("seed", range(5))
def test_parts_give_the_rows_of_the_whole(monkeypatch, seed):
    rnd = random.Random(seed)
    for _ in range(60):
        script, module = ("".join(rnd.choice(lines) % rnd.randrange(99) for _ in range(rnd.randrange(1, 20))) for lines in (SCRIPT, PYTHON))
        whole = scan.scan_script(script), scan.scan_python(module)
        monkeypatch.setattr(scan, "PART", rnd.choice([1, 10, 40]))
        monkeypatch.setattr(scan, "PART_TOKENS", rnd.choice([1, 3, 8]))
        assert (scan.scan_script(script), scan.scan_python(module)) == whole
        assert scan.scan_python(module + "def broken(:\n") == []
        monkeypatch.undo()


def test_places_are_not_counted_from_the_top_each_time():
    """Ten times the lines must not take a hundred times as long."""

    def seconds(n):
        text = "".join(f"export function é{i}() {{ g{i}(); }} // x\n" for i in range(n))
        begun = time.process_time()
        rows = scan.scan_script(text)
        took = time.process_time() - begun
        assert len(rows) == 2 * n and text.encode()[rows[-2]["byte"] :].startswith(b"function")
        return took

    small = min(seconds(3000) for _ in range(3))
    assert seconds(30_000) < 30 * small


def test_a_large_module_is_held_in_parts():
    text = "".join(f"def fn_{i}(x):\n    return fn_{i + 1}(x)\n" for i in range(30_000))
    tracemalloc.start()
    n = sum(len(rows) for rows in scan.python_parts(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 60_000 and peak < 40e6  # the tree of the whole takes about 200
