"""API specifications: OpenAPI 2 and 3 as endpoints, GraphQL SDL as types."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import BadInput, MissingDependency

# Methods, media types in order of preference, limits of a simplified schema.
METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "trace")
MEDIA = ("application/json", "application/x-www-form-urlencoded", "*/*")
DEPTH, PROPERTIES, VARIANTS, SNIFF = 2, 8, 3, 2000
SCALARS = ("string", "integer", "number", "boolean", "null")
BUILT_IN = ("String", "Int", "Float", "Boolean", "ID")
ENDPOINTS = (
    "source string, ord int, method string, path string, summary string, description string, tags array<string>, deprecated boolean, operation_id string, "
    "parameters array<struct<name:string,`in`:string,required:boolean,type:string,description:string>>, request_body string, responses map<string,string>"
)
TYPES = "source string, ord int, name string, kind string, operation string, description string, fields array<struct<name:string,type:string,args:array<string>,description:string>>"


def detect(name: str, text: str, content_type: str | None = None) -> str:
    """openapi-json, openapi-yaml or graphql: by extension, by how the text begins, by content type."""
    ext = Path(name).suffix.lower()
    head = text[:SNIFF]
    by_type = (content_type or "").partition(";")[0].strip().lower()
    rules = [
        ("graphql", ext in (".graphql", ".gql")), ("openapi-yaml", ext in (".yaml", ".yml")), ("openapi-json", ext == ".json"),
        ("openapi-yaml", bool(re.search(r"^openapi:", head, re.M))), ("openapi-json", '"openapi"' in head or '"swagger"' in head),
        ("graphql", bool(re.search(r"type Query|schema \{|type Mutation", head))), ("openapi-json", _names_version(text)),
        ("openapi-json", by_type == "application/json" or by_type.endswith("+json")), ("openapi-yaml", "yaml" in by_type), ("graphql", "graphql" in by_type),
    ]
    found = next((kind for kind, holds in rules if holds), None)
    if found is None:
        raise BadInput(f"{name} is neither an OpenAPI nor a GraphQL document")
    return found


def _names_version(text: str) -> bool:
    try:
        value = json.loads(text)
    except ValueError:
        return False
    return isinstance(value, dict) and bool({"openapi", "swagger"} & value.keys())


def load(name: str, text: str, content_type: str | None = None) -> tuple[str, Any]:
    kind = detect(name, text, content_type)
    try:
        if kind == "openapi-json":
            return kind, json.loads(text)
        if kind == "openapi-yaml":
            try:
                import yaml
            except ImportError as e:
                raise MissingDependency("pyyaml", "YAML specifications") from e
            return kind, yaml.safe_load(text)
    except MissingDependency:
        raise
    except Exception as e:
        raise BadInput(f"{name} can't be parsed: {e}") from e
    return kind, text


class Api:
    """An OpenAPI document with its named components."""

    def __init__(self, data: dict):
        if not isinstance(data, dict):
            raise BadInput("an OpenAPI document is an object")
        self.data, self.version = data, str(data.get("openapi") or data.get("swagger") or "")
        self.three = self.version.startswith("3")
        own = data.get("components") or {}
        self.named: dict[str, Any] = {}
        for section in ("responses", "requestBodies", "parameters", "schemas") if self.three else ():
            self.named |= own.get(section) or {}
        if not self.three:
            self.named = dict(data.get("definitions") or {})
        self.warnings = [] if self.version else ["No 'openapi' or 'swagger' version key found"]

    def servers(self) -> list[str]:
        if self.three:
            return [s["url"] for s in self.data.get("servers") or [] if s.get("url")]
        host = self.data.get("host")
        return [f"{(self.data.get('schemes') or ['https'])[0]}://{host}{self.data.get('basePath', '')}"] if host else []

    def target(self, node: Any, seen: tuple[str, ...] = ()) -> Any:
        """What a reference points to, by its last segment; itself if there is no such component."""
        if isinstance(node, dict) and (ref := node.get("$ref")):
            name = ref.rpartition("/")[2]
            return self.named.get(name) or node
        return node

    def schema(self, node: Any, depth: int = 0, seen: frozenset[str] = frozenset()) -> str:
        """A schema in a line. References within themselves are named only."""
        if not node:
            return "any"
        if ref := node.get("$ref"):
            if ref in seen:
                return ref.rpartition("/")[2]
            seen |= {ref}
            node = self.target(node)
        kind, title = node.get("type"), node.get("title")
        if kind == "array" or "items" in node:
            items = node.get("items") or {}
            name = self.target(items).get("title") or items.get("$ref", "").rpartition("/")[2]
            return f"array[{name or self.schema(items, depth, seen)}]"
        if kind in SCALARS:
            return f"{kind}({node['format']})" if node.get("format") else kind
        fields = node.get("properties") or {}
        if not fields:
            for joint, keys, most in ((" & ", ("allOf",), None), (" | ", ("oneOf", "anyOf"), VARIANTS)):
                if parts := next((node[k] for k in keys if k in node), None):
                    return joint.join(self.schema(p, depth, seen) for p in parts[:most])
            return title or kind or "object"
        label = title or "object"
        if depth >= DEPTH:
            return label + "{...}"
        shown = [f"{k}: {self.schema(v, depth + 1, seen)}" for k, v in list(fields.items())[:PROPERTIES]]
        return f"{label} {{{', '.join(shown + ['...'] * (len(fields) > PROPERTIES))}}}"

    def body_schema(self, body: Any) -> dict | None:
        content = (self.target(body) or {}).get("content") or {}
        ordered = [content[m] for m in MEDIA if m in content] + list(content.values())
        return next((m["schema"] for m in ordered if m.get("schema")), None)

    def response(self, node: Any) -> str:
        node = self.target(node)
        schema = next((m["schema"] for m in (node.get("content") or {}).values() if m.get("schema")), None) if node.get("content") else node.get("schema")
        return self.schema(schema) if schema else node.get("description") or "—"

    def endpoints(self) -> Iterator[tuple]:
        for path, item in (self.data.get("paths") or {}).items():
            for method, op in (item.items() if isinstance(item, dict) else ()):
                if method.lower() not in METHODS or not isinstance(op, dict):
                    continue
                merged = {(p.get("name"), p.get("in")): p for p in map(self.target, [*(item.get("parameters") or []), *(op.get("parameters") or [])])}
                params, body = list(merged.values()), self.body_schema(op.get("requestBody")) if self.three else None
                if not self.three:
                    body = next((p.get("schema") or {} for p in params if p.get("in") == "body"), None)
                    params = [p for p in params if p.get("in") != "body"]
                rows = [(p.get("name"), p.get("in"), bool(p.get("required")), self.schema(p.get("schema") or {k: p[k] for k in ("type", "format", "items") if k in p}), p.get("description")) for p in params]
                answers = {str(k): self.response(v) for k, v in (op.get("responses") or {}).items() if isinstance(v, dict)}
                yield (method.upper(), path, op.get("summary"), op.get("description"), [str(t) for t in op.get("tags") or []], bool(op.get("deprecated")), op.get("operationId"), rows, None if body is None else self.schema(body), answers)


def endpoints(spark: SparkSession, source: str, data: dict) -> DataFrame:
    return spark.createDataFrame([(source, k, *e) for k, e in enumerate(Api(data).endpoints())], ENDPOINTS)


def filter_endpoints(df: DataFrame, deprecated: bool = False, tags: list[str] | None = None, path: str | None = None, methods: list[str] | None = None, detail: bool = True) -> DataFrame:
    """Endpoints by tag, by part of the path, by method; deprecated ones only if asked for; details or not."""
    keep = F.lit(True) if deprecated else ~F.col("deprecated")
    if tags:
        keep = keep & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if path:
        keep = keep & F.col("path").contains(path)
    if methods:
        keep = keep & F.col("method").isin([m.upper() for m in methods])
    return df.where(keep) if detail else df.where(keep).drop("parameters", "request_body", "responses")


_sdl = re.compile(r'(?P<skip>[\s,﻿]+|#[^\n]*)|(?P<block>"""(?:\\"""|.)*?""")|(?P<text>"(?:\\.|[^"\\\n])*")|(?P<name>[_A-Za-z]\w*)|(?P<number>-?\d[\d.eE+-]*)|(?P<mark>\.\.\.|[!$&()\[\]{}:=@|])', re.S)


class Sdl:
    """A reader of GraphQL's schema language."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _sdl.match(text, at)
            if not m:
                raise BadInput(f"Invalid GraphQL SDL: unexpected {text[at]!r} at {at}")
            at = m.end()
            if m.lastgroup != "skip":
                self.tokens.append((m.lastgroup, m.group()))
        self.k = 0

    def peek(self) -> str:
        return self.tokens[self.k][1] if self.k < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        if self.k >= len(self.tokens) or (wanted and self.tokens[self.k][1] not in wanted):
            raise BadInput(f"Invalid GraphQL SDL: expected {' or '.join(wanted) or 'more'}, found {self.peek() or 'the end'}")
        self.k += 1
        return self.tokens[self.k - 1][1]

    def name(self) -> str:
        if self.k >= len(self.tokens) or self.tokens[self.k][0] != "name":
            raise BadInput(f"Invalid GraphQL SDL: expected a name, found {self.peek() or 'the end'}")
        return self.take()

    def described(self) -> str | None:
        if self.k < len(self.tokens) and self.tokens[self.k][0] in ("block", "text"):
            raw = self.take()
            return (raw[3:-3] if raw.startswith('"""') else raw[1:-1]).strip() or None
        return None

    def type_text(self) -> str:
        out = f"[{self.type_text()}" + self.take("]") if self.peek() == "[" and self.take("[") else self.name()
        return out + (self.take("!") if self.peek() == "!" else "")

    def value(self) -> None:
        if self.peek() in ("[", "{"):
            close = {"[": "]", "{": "}"}[self.take()]
            while self.peek() != close:
                self.value()
            self.take(close)
        else:
            self.take()
            if self.peek() == ":":
                self.take(":")
                self.value()

    def directives(self) -> None:
        while self.peek() == "@":
            self.take("@")
            self.take()
            if self.peek() == "(":
                self.arguments(False)

    def arguments(self, typed: bool = True) -> list[str]:
        out = []
        self.take("(")
        while self.peek() != ")":
            self.described()
            name = self.take()
            self.take(":")
            if typed:
                out.append(f"{name}: {self.type_text()}")
                if self.peek() == "=":
                    self.take("=")
                    self.value()
                self.directives()
            else:
                self.value()
        self.take(")")
        return out

    def types(self) -> list[tuple]:
        """name, kind, operation, description, fields of each type; roots are as the schema names them."""
        roots, found = {"Query": "query", "Mutation": "mutation", "Subscription": "subscription"}, {}
        while self.k < len(self.tokens):
            about = self.described()
            if self.peek() == "extend":
                self.take()
            word = self.take("type", "interface", "input", "union", "enum", "scalar", "schema", "directive")
            if word == "schema":
                self.directives()
                roots = {}
                self.take("{")
                while self.peek() != "}":
                    self.described()
                    op = self.take("query", "mutation", "subscription")
                    self.take(":")
                    roots[self.take()] = op
                self.take("}")
                continue
            if word == "directive":
                self.take("@")
                self.take()
                if self.peek() == "(":
                    self.arguments()
                if self.peek() == "repeatable":
                    self.take()
                self.take("on")
                while self.k < len(self.tokens) and (self.peek() == "|" or re.fullmatch("[A-Z_]+", self.peek())):
                    self.take()
                continue
            name = self.name()
            if self.peek() == "implements":
                self.take()
                while self.peek() == "&" or self.tokens[self.k][0] == "name":
                    self.take()
            self.directives()
            kind = {"type": "object"}.get(word, word)
            fields = self._body(word)
            if name in found:
                found[name][4].extend(fields)
            else:
                found[name] = (name, kind, None, about, fields)
        return [(n, k, roots.get(n) if k == "object" else None, a, f) for n, k, _, a, f in found.values()]

    def _body(self, word: str) -> list[tuple]:
        out: list[tuple] = []
        if word == "union" and self.peek() == "=":
            self.take("=")
            members = []
            while self.peek() == "|" or (not members and self.tokens[self.k][0] == "name"):
                if self.peek() == "|":
                    self.take("|")
                members.append(self.take())
            return [("members", " | ".join(members), [], None)]
        if self.peek() != "{":
            return out
        self.take("{")
        while self.peek() != "}":
            about = self.described()
            name = self.name()
            if word == "enum":
                self.directives()
                out.append((name, "enum_value", [], None))
                continue
            args = self.arguments() if self.peek() == "(" else []
            self.take(":")
            own = self.type_text()
            if self.peek() == "=":
                self.take("=")
                self.value()
            self.directives()
            out.append((name, own, args, about))
        self.take("}")
        return out


def graphql_types(spark: SparkSession, source: str, text: str) -> DataFrame:
    return spark.createDataFrame([(source, k, *t) for k, t in enumerate(Sdl(text).types())], TYPES)
