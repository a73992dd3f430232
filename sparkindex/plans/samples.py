"""Small sources with their symbols, references and resolution, written by hand."""

from __future__ import annotations

SOURCES = [
    (
        "shop/cart.py",
        "python",
        '''import json
from .prices import total as add_up, Tax
from . import stock

LIMIT = 10


@register
class Cart(Base, models.Thing):
    size: int = 0

    def add(self, item,
            count=1) -> None:
        inner = make(item)
        def helper():
            return f"{fmt(inner)}"
        self.items.append(helper())

    async def pay(self):
        return await add_up(self.items)


def clear(cart): reset(cart); cart.add(None)


LIMIT = 20
''',
    ),
    (
        "shop/prices.py",
        "python",
        '''class Tax:
    rate = 0.2


def total(items):
    if not items:
        return 0
    return items[0] + total(items[1:])


def fmt(x):
    return str(x)
''',
    ),
    (
        "web/app.tsx",
        "tsx",
        """import React, { useState as state } from "react";
import { load } from "./api";

export const Page = ({ id }: Props) => {
  const [data] = state(load(id));
  return <Card title={fmt(data)}><Ui.Row /></Card>;
};

export class Cache<T> extends Base<T> implements Store {
  static size = 4;
  onDrop = (x: T): void => this.evict(x);
  get(key: string): T | undefined { return this.map.get(key); }
}

export default Page;
""",
    ),
    (
        "web/api.ts",
        "typescript",
        """export interface Reply { ok(): boolean }
export function load(id: string): Reply;
export function load(id: any): any {
  return fetch(`/x/${encode(id)}`);
}
export { parse as read } from "./parse";
""",
    ),
]

#: path, name, qualified name, kind, first line, last line, signature, parent
SYMBOLS = [
    ("shop/cart.py", "json", "json", "import", 1, 1, "json", None),
    ("shop/cart.py", "add_up", "add_up", "import", 2, 2, ".prices.total", None),
    ("shop/cart.py", "Tax", "Tax", "import", 2, 2, ".prices.Tax", None),
    ("shop/cart.py", "stock", "stock", "import", 3, 3, ".stock", None),
    ("shop/cart.py", "LIMIT", "LIMIT", "const", 5, 5, None, None),
    ("shop/cart.py", "Cart", "Cart", "class", 9, 20, "class Cart(Base, models.Thing)", None),
    ("shop/cart.py", "size", "Cart.size", "const", 10, 10, None, "Cart"),
    ("shop/cart.py", "add", "Cart.add", "method", 12, 17, "def add(self, item, count=1) -> None", "Cart"),
    ("shop/cart.py", "helper", "Cart.add.helper", "function", 15, 16, "def helper()", "Cart.add"),
    ("shop/cart.py", "pay", "Cart.pay", "method", 19, 20, "async def pay(self)", "Cart"),
    ("shop/cart.py", "clear", "clear", "function", 23, 23, "def clear(cart)", None),
    ("shop/prices.py", "Tax", "Tax", "class", 1, 2, "class Tax", None),
    ("shop/prices.py", "rate", "Tax.rate", "const", 2, 2, None, "Tax"),
    ("shop/prices.py", "total", "total", "function", 5, 8, "def total(items)", None),
    ("shop/prices.py", "fmt", "fmt", "function", 11, 12, "def fmt(x)", None),
    ("web/app.tsx", "React", "React", "import", 1, 1, "react:default", None),
    ("web/app.tsx", "state", "state", "import", 1, 1, "react:useState", None),
    ("web/app.tsx", "load", "load", "import", 2, 2, "./api:load", None),
    ("web/app.tsx", "Page", "Page", "function", 4, 7, "const Page = ({ id }: Props) =>", None),
    ("web/app.tsx", "Cache", "Cache", "class", 9, 13, "class Cache<T> extends Base<T> implements Store", None),
    ("web/app.tsx", "size", "Cache.size", "const", 10, 10, None, "Cache"),
    ("web/app.tsx", "onDrop", "Cache.onDrop", "method", 11, 11, "onDrop = (x: T): void =>", "Cache"),
    ("web/app.tsx", "get", "Cache.get", "method", 12, 12, "get(key: string): T | undefined", "Cache"),
    ("web/api.ts", "load", "load", "function", 3, 5, "function load(id: any): any", None),
    ("web/api.ts", "read", "read", "import", 6, 6, "./parse:parse", None),
]

#: path, name, line
REFERENCES = [
    ("shop/cart.py", "register", 8),
    ("shop/cart.py", "Base", 9),
    ("shop/cart.py", "Thing", 9),
    ("shop/cart.py", "make", 14),
    ("shop/cart.py", "fmt", 16),
    ("shop/cart.py", "append", 17),
    ("shop/cart.py", "helper", 17),
    ("shop/cart.py", "add_up", 20),
    ("shop/cart.py", "add", 23),
    ("shop/cart.py", "reset", 23),
    ("shop/prices.py", "total", 8),
    ("shop/prices.py", "str", 12),
    ("web/app.tsx", "load", 5),
    ("web/app.tsx", "state", 5),
    ("web/app.tsx", "Card", 6),
    ("web/app.tsx", "Row", 6),
    ("web/app.tsx", "fmt", 6),
    ("web/app.tsx", "Base", 9),
    ("web/app.tsx", "Store", 9),
    ("web/app.tsx", "evict", 11),
    ("web/app.tsx", "get", 12),
    ("web/app.tsx", "Page", 15),
    ("web/api.ts", "encode", 4),
    ("web/api.ts", "fetch", 4),
]

_FOUND = {
    ("shop/cart.py", "fmt", 16): ("name-only", "shop/prices.py", "fmt"),
    ("shop/cart.py", "helper", 17): ("exact", "shop/cart.py", "Cart.add.helper"),
    ("shop/cart.py", "add_up", 20): ("import", "shop/prices.py", "total"),
    ("shop/cart.py", "add", 23): ("exact", "shop/cart.py", "Cart.add"),
    ("shop/prices.py", "total", 8): ("exact", "shop/prices.py", "total"),
    ("web/app.tsx", "load", 5): ("import", "web/api.ts", "load"),
    ("web/app.tsx", "fmt", 6): ("name-only", "shop/prices.py", "fmt"),
    ("web/app.tsx", "get", 12): ("exact", "web/app.tsx", "Cache.get"),
    ("web/app.tsx", "Page", 15): ("exact", "web/app.tsx", "Page"),
}
#: path, name, line, confidence, resolved path, resolved qualified name
RESOLVED = [(*r, *_FOUND.get(r, ("name-only", None, None))) for r in REFERENCES]

_JS = ("ts", "tsx", "js", "jsx")


def _js(base: str, name: str) -> str:
    return " ".join([f"{base}.{s}#{name}" for s in _JS] + [f"{base}/index.{s}#{name}" for s in _JS])


#: language, target, importing file, candidates in order
CANDIDATES = [
    ("python", "json", "a.py", ""),
    ("python", "pkg.mod.f", "x/y.py", "pkg/mod.py#f pkg/mod/__init__.py#f"),
    ("python", ".sib", "x/y.py", "x.py#sib x/__init__.py#sib"),
    ("python", ".m.f", "x/y.py", "x/m.py#f x/m/__init__.py#f"),
    ("python", "..m.f", "x/y/z.py", "x/m.py#f x/m/__init__.py#f"),
    ("python", "....m.f", "x/y.py", "m.py#f m/__init__.py#f"),
    ("python", ".f", "a.py", "__init__.py#f"),
    ("python", "..", "a/b.py", ""),
    ("typescript", "./api:load", "web/app.ts", _js("web/api", "load")),
    ("tsx", "../lib/./x:default", "web/ui/app.tsx", _js("web/lib/x", "default")),
    ("javascript", "../../up:f", "a/b.js", _js("../up", "f")),
    ("javascript", "react:default", "a/b.js", ""),
    ("javascript", "./all:*", "a/b.js", ""),
    ("javascript", "./x.js:f", "a/b.js", _js("a/x.js", "f")),
]
