"""The named tools over a catalog of indexes, and the request envelope that calls them.

A host passes the project along with each request; there is no search across projects.
"""

from __future__ import annotations

import hmac
import json
import secrets
from collections.abc import Callable
from typing import Any

from .operators import search
from .operators.index import Catalog
from .plans.access import as_json


def schema(required: list[str], properties: dict[str, tuple[str, str]]) -> dict:
    """A JSON schema of a tool's arguments: names with their type and description."""
    return {"type": "object", "properties": {n: {"type": t, "description": d} for n, (t, d) in properties.items()}, "required": required}


TOOLS: dict[str, dict] = {
    "search_code": {
        "description": "Find chunks of a project by meaning: path, lines, symbol, score and snippet of the best.",
        "inputSchema": schema(
            ["query"],
            {
                "query": ("string", "What to look for"),
                "k": ("number", "How many hits, 8 by default, 50 at most"),
                "repo": ("string", "Only this repository"),
                "language": ("string", "Only this language"),
                "path_prefix": ("string", "Only paths that begin like this"),
            },
        ),
    },
    "get_chunk": {"description": "The whole text of one chunk and where it is from.", "inputSchema": schema(["chunk_id"], {"chunk_id": ("number", "The id of a hit")})},
    "list_repos": {"description": "The repositories of a project with their files and bytes.", "inputSchema": schema([], {})},
    "index_status": {"description": "Counts of files and chunks, the last sweep, the model and its dimension.", "inputSchema": schema([], {})},
}


class ToolError(Exception):
    """What a caller is told about a call that cannot be answered."""


class Service:
    def __init__(self, catalog: Catalog, name: str = "lodestream", version: str = "1"):
        self.catalog, self.name, self.version = catalog, name, version
        self._tools: dict[str, Callable[[str, dict], Any]] = {"search_code": self._search, "get_chunk": self._chunk, "list_repos": self._repos, "index_status": self._status}

    def list_tools(self) -> list[dict]:
        return [{"name": name, **tool} for name, tool in TOOLS.items()]

    def call(self, project: str, tool: str, arguments: dict | None = None) -> Any:
        if tool not in self._tools:
            raise ToolError(f"unknown tool: {tool}")
        if project not in self.catalog.projects.names:
            raise ToolError(f"unknown project: {project}")
        return self._tools[tool](project, arguments or {})

    def _search(self, project: str, arguments: dict) -> dict:
        query = str(arguments.get("query") or "").strip()
        if not query:
            raise ToolError("query is required")
        index = self.catalog.index(project)
        k = arguments.get("k")
        hits = search.search_text(
            index.files.read(), index.chunks.read(), index.model, query, k=None if k is None else int(k), repo=arguments.get("repo"), language=arguments.get("language"), path_prefix=arguments.get("path_prefix"), roots=self.catalog.projects.get(project).roots
        )
        rows = [as_json(r) for r in hits.collect()]
        return {"project": project, "query": query, "count": len(rows), "hits": rows}

    def _chunk(self, project: str, arguments: dict) -> dict:
        try:
            number = int(arguments.get("chunk_id"))
        except (TypeError, ValueError):
            raise ToolError("chunk_id is required") from None
        index = self.catalog.index(project)
        try:
            return as_json(search.get_chunk(index.files.read(), index.chunks.read(), number))
        except KeyError as e:
            raise ToolError(e.args[0]) from None

    def _repos(self, project: str, _: dict) -> dict:
        return {"project": project, "repos": [as_json(r) for r in search.list_repos(self.catalog.index(project).files.read()).collect()]}

    def _status(self, project: str, _: dict) -> dict:
        return as_json(self.catalog.index(project).status())

    def authorized(self, path: str, headers: dict[str, str], tokens: dict[str, str] | None) -> str:
        """The project that a request's path names (its last part), once the bearer token is that project's; no tokens means no check."""
        project = path.split("?")[0].rstrip("/").rpartition("/")[2]
        if project not in self.catalog.projects.names:
            raise ToolError(f"unknown project: {project}")
        if tokens is not None:
            stated = {k.lower(): v for k, v in headers.items()}.get("authorization", "")
            kind, _, token = stated.partition(" ")
            if kind.lower() != "bearer" or not hmac.compare_digest(token.strip().encode(), tokens.get(project, secrets.token_hex()).encode()):
                raise ToolError("unauthorized")
        return project

    def handle(self, project: str, request: dict) -> dict | None:
        """Answer a JSON-RPC request; notifications have no answer, and a failing tool answers with an error result."""
        method, number = request.get("method", ""), request.get("id")
        if method.startswith("notifications/"):
            return None
        if method == "initialize":
            result: Any = {"serverInfo": {"name": self.name, "version": self.version}, "capabilities": {"tools": {}}}
        elif method == "ping":
            result = {}
        elif method == "tools/list":
            result = {"tools": self.list_tools()}
        elif method == "tools/call":
            params = request.get("params") or {}
            try:
                content, failed = json.dumps(self.call(project, params.get("name", ""), params.get("arguments"))), False
            except ToolError as e:
                content, failed = str(e), True
            result = {"content": [{"type": "text", "text": content}], "isError": failed}
        else:
            return {"jsonrpc": "2.0", "id": number, "error": {"code": -32601, "message": f"unknown method: {method}"}}
        return {"jsonrpc": "2.0", "id": number, "result": result}
