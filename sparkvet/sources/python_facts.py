"""Facts of Python source files, read without running them: functions, calls, tools, findings, flows, strings, unread files.

A file that doesn't parse gives one parse_error. Tools that are listed as objects (extra `listed`) start at the object; what they run is told by
`dispatch` rows (blocks under a comparison with a name) and `call_handler` rows, which may lie in other files.
"""

from __future__ import annotations

import ast

from sparkvet.sources import python_flow

#: Capability of an imported name: first match of (kind, name, capability); a trailing * stands for the rest.
API = [
    ("module", "subprocess.*", "exec"), ("module", "os.system", "exec"), ("module", "os.popen", "exec"), ("module", "os.exec*", "exec"),
    ("module", "os.spawn*", "exec"), ("module", "pty.spawn", "exec"), ("module", "asyncio.create_subprocess_*", "exec"),
    ("global", "eval", "dynamic_code"), ("global", "exec", "dynamic_code"), ("global", "compile", "dynamic_code"), ("module", "importlib.import_module", "dynamic_code"),
    ("module", "os.remove", "fs_delete"), ("module", "os.unlink", "fs_delete"), ("module", "os.rmdir", "fs_delete"), ("module", "shutil.rmtree", "fs_delete"),
    ("module", "os.rename", "fs_write"), ("module", "os.makedirs", "fs_write"), ("module", "os.mkdir", "fs_write"), ("module", "shutil.*", "fs_write"),
    ("module", "os.listdir", "fs_read"), ("module", "os.walk", "fs_read"), ("module", "glob.*", "fs_read"),
    ("module", "requests.*", "network"), ("module", "httpx.*", "network"), ("module", "urllib.request.*", "network"), ("module", "aiohttp.*", "network"), ("module", "socket.*", "network"), ("module", "smtplib.*", "network"),
    ("module", "os.kill", "process_control"), ("module", "signal.*", "process_control"),
    ("method", "write_text", "fs_write"), ("method", "write_bytes", "fs_write"), ("method", "read_text", "fs_read"), ("method", "read_bytes", "fs_read"),
]

SENDING = ("post", "put", "patch", "send", "sendmail", "sendall", "sendto")


def capability(name: str, imported: bool, method: bool) -> str | None:
    """Of a qualified name: modules for imported ones, globals for bare ones, methods as the last resort."""
    def hit(pattern: str, text: str) -> bool:
        return text.startswith(pattern[:-1]) if pattern.endswith("*") else text == pattern

    kind = "module" if imported else "global"
    for k, pattern, found in API:
        if k == kind and hit(pattern, name):
            return found
    last = name.rpartition(".")[2]
    return next((c for k, p, c in API if method and k == "method" and hit(p, last)), None)


class _File(ast.NodeVisitor):
    def __init__(self, pkg: str, path: str, source: bytes):
        self.pkg, self.path, self.rows = pkg, path, []
        self.lines = [0]
        for line in source.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))
        self.imports: dict[str, str] = {}
        self.constants: dict[str, str] = {}
        self.added: list[tuple[ast.Call, str | None]] = []
        self.functions: dict[str, ast.FunctionDef | ast.AsyncFunctionDef] = {}

    def at(self, node: ast.AST) -> int:
        return self.lines[node.lineno - 1] + node.col_offset

    def end(self, node: ast.AST) -> int:
        return self.lines[node.end_lineno - 1] + node.end_col_offset

    def add(self, fact: str, node: ast.AST, name: str | None = None, detail: str | None = None, **extra: str | None) -> None:
        self.rows.append((self.pkg, self.path, fact, name, detail, self.at(node), self.end(node), node.lineno, {k: v for k, v in extra.items() if v is not None}))

    def qualified(self, node: ast.AST) -> tuple[str | None, bool]:
        """Dotted name, and whether its first part is imported."""
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name):
            return (".".join(["", *reversed(parts)]) if parts else None), False
        first = self.imports.get(node.id)
        return ".".join([first or node.id, *reversed(parts)]), first is not None

    def text(self, node: ast.AST | None, depth: int = 0) -> tuple[str | None, bool]:
        """(text with {} for unknown parts, whether parts are unknown)."""
        if depth > 5 or node is None:
            return None, True
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value, False
        if isinstance(node, ast.Name) and node.id in self.constants:
            return self.constants[node.id], False
        if isinstance(node, ast.JoinedStr):
            parts = [self.text(v, depth + 1)[0] if isinstance(v, ast.Constant) else "{}" for v in node.values]
            return "".join(p or "{}" for p in parts), "{}" in parts
        if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
            (a, x), (b, y) = self.text(node.left, depth + 1), self.text(node.right, depth + 1)
            return (None, True) if a is None and b is None else ((a or "{}") + (b or "{}"), x or y)
        return None, True

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.imports[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
            self.add("import", node, a.name)

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.imports[a.asname or a.name] = f"{'.' * node.level}{node.module or ''}.{a.name}"
            self.add("import", node, f"{'.' * node.level}{node.module or ''}", a.name)

    def visit_Assign(self, node: ast.Assign) -> None:
        value, dynamic = self.text(node.value)
        if value is not None and not dynamic:
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.constants[t.id] = value
        self.generic_visit(node)

    def _function(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.add("function", node, node.name)
        self.functions.setdefault(node.name, node)
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            target = call.func if call else d
            name, imported = self.qualified(target)
            if name and (name.endswith(".tool") or imported and name.endswith(".tool") or name == "tool" and imported):
                self._tool(node, call)
            elif name and name.endswith(".call_tool"):
                self.add("call_handler", node, None, node.name)
        self.generic_visit(node)

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def add_tools(self) -> None:
        """Tools whose function is handed over in a call; functions of a file are known only at its end."""
        for call, function in self.added:
            node = self.functions.get(function)
            if node is None:
                self.add("flow_gap", call, "handler_unknown", function)
            else:
                self._tool(node, call, 1)

    def visit_If(self, node: ast.If) -> None:
        t = node.test
        if isinstance(t, ast.Compare) and len(t.ops) == 1 and isinstance(t.ops[0], ast.Eq):
            for side in (t.left, t.comparators[0]):
                if isinstance(side, ast.Constant) and isinstance(side.value, str):
                    last = node.body[-1]
                    self.rows.append((self.pkg, self.path, "dispatch", side.value, None, self.at(node.body[0]), self.end(last), node.lineno, {}))
        self.generic_visit(node)

    def _listed(self, node: ast.Call, words: dict[str, ast.expr]) -> None:
        name, description = self.text(words["name"])[0], self.text(words.get("description"))
        if name is None:
            return self.add("flow_gap", node, "tool_name_unknown")
        schema = words["inputSchema"]
        fields = dict(zip([k.value for k in schema.keys if isinstance(k, ast.Constant)], schema.values, strict=False)).get("properties") if isinstance(schema, ast.Dict) else None
        parameters = [k.value for k in fields.keys if isinstance(k, ast.Constant) and isinstance(k.value, str)] if isinstance(fields, ast.Dict) else []
        self.add("tool", node, name, description[0] or "", listed="true", dynamic=str(description[1]).lower(), parameters=",".join(parameters))

    def _tool(self, node, call: ast.Call | None, place: int = 0) -> None:
        words = {k.arg: k.value for k in call.keywords} if call else {}
        name = self.text(words.get("name") or (call.args[place] if call and len(call.args) > place else None))[0] or node.name
        description, dynamic = (self.text(words["description"]) if "description" in words else (ast.get_docstring(node) or "", False))
        hints = {}
        if isinstance(words.get("annotations"), ast.Dict):
            hints = {k.value: v for k, v in zip(words["annotations"].keys, words["annotations"].values, strict=True) if isinstance(k, ast.Constant)}
        elif isinstance(words.get("annotations"), ast.Call):
            hints = {k.arg: k.value for k in words["annotations"].keywords}
        hint = lambda k: None if k not in hints else str(hints[k].value).lower() if isinstance(hints[k], ast.Constant) and isinstance(hints[k].value, bool) else "computed"
        arguments = [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs) if a.arg not in ("self", "cls", "ctx", "context")]
        self.add("tool", node, name, description, function=node.name, dynamic=str(dynamic).lower(), read_only=hint("readOnlyHint"), open_world=hint("openWorldHint"), title=self.text(words.get("title"))[0], parameters=",".join(arguments))

    def visit_Call(self, node: ast.Call) -> None:
        name, imported = self.qualified(node.func)
        if name:
            self.add("call", node, name.rpartition(".")[2], name, imported=str(imported).lower())
            for a in (*node.args, *(k.value for k in node.keywords)):
                if isinstance(a, ast.Name):
                    self.add("call", node, a.id, a.id, imported="argument")
            words = {k.arg: k.value for k in node.keywords}
            handed = node.args[0] if node.args else words.get("fn")
            if "." in name and name.endswith((".add_tool", ".from_function")) and isinstance(handed, (ast.Name, ast.Attribute)):
                self.added.append((node, handed.id if isinstance(handed, ast.Name) else handed.attr))
            elif name.rpartition(".")[2] == "Tool" and "name" in words and "inputSchema" in words:
                self._listed(node, words)
            self._finding(node, name, imported)
        self.generic_visit(node)

    def _finding(self, node: ast.Call, name: str, imported: bool) -> None:
        words = {k.arg: k.value for k in node.keywords}
        if name == "open" and not imported:
            mode = words.get("mode") or (node.args[1] if len(node.args) > 1 else None)
            value, dynamic = self.text(mode) if mode is not None else ("r", False)
            self.add("finding", node, "fs_write" if dynamic or any(c in (value or "") for c in "wax+") else "fs_read", name)
            return
        if name in ("os.getenv", "os.environ.get"):
            key, dynamic = self.text(node.args[0] if node.args else None)
            self.add("finding", node, "env_read", None if dynamic else key)
            return
        found = capability(name, imported, isinstance(node.func, ast.Attribute))
        if found is None:
            return
        extra = {}
        if found == "network":
            url, dynamic = self.text(words.get("url") or (node.args[0] if node.args else None))
            whole = url is not None and url.startswith(("http://", "https://"))
            host = url.split("//", 1)[1] if whole else ""
            ended = any(c in host for c in "/?#")
            host = host.split("/")[0].split("?")[0].split("#")[0].split(":")[0].lower()
            known = whole and host and "{}" not in host and (ended or not dynamic)
            verb = name.rpartition(".")[2]
            extra = {"url_kind": "unknown" if not node.args and "url" not in words else "dynamic" if dynamic else "literal", "url_host": host if known else None, "has_address": str(url is not None or bool(node.args)).lower(), "sends": str(verb in SENDING or any(k in words for k in ("data", "json", "files", "content"))).lower()}
        self.add("finding", node, found, name if imported or "." not in name else f".{name.rpartition('.')[2]}", **extra)

    def visit_Subscript(self, node: ast.Subscript) -> None:
        name, imported = self.qualified(node.value)
        if imported and name == "os.environ":
            key, dynamic = self.text(node.slice)
            self.add("finding", node, "env_read", None if dynamic else key)
        self.generic_visit(node)

    def visit_Constant(self, node: ast.Constant) -> None:
        if isinstance(node.value, str) and node.value:
            self.add("string", node, None, node.value)


def facts_of(pkg: str, path: str, source: bytes) -> list[tuple]:
    reader = _File(pkg, path, source)
    try:
        tree = ast.parse(source)
        reader.visit(tree)
        reader.add_tools()
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:  # what can't be read to the end counts as unread
        return [(pkg, path, "parse_error", type(e).__name__, str(e)[:200], 0, len(source), getattr(e, "lineno", None) or 0, {})]
    tools = [(r[3], r[8]["function"]) for r in reader.rows if r[2] == "tool" and "function" in r[8]]
    tools += [(None, r[4]) for r in reader.rows if r[2] == "call_handler"]
    try:
        found, gaps = python_flow.flows(reader, tree, tools)
    except (RecursionError, MemoryError) as e:
        found, gaps = [], [type(e).__name__]
    for gap in gaps:
        reader.rows.append((pkg, path, "flow_gap", gap, None, 0, len(source), 0, {}))
    for tool, h in found:
        extra = {"tool": tool, "kind": h.label.kind, "pasted": str(h.label.pasted).lower(), "role": h.role, "path_kinds": ",".join(h.path_kinds), "steps": str(h.steps)}
        reader.rows.append((pkg, path, "flow", h.sink, h.label.source, h.offset, h.offset, h.line, {k: v for k, v in extra.items() if v}))
    return reader.rows
