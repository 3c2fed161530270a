"""The tools on the command line: python -m plumbline TOOL --name value ... [--output FILE]."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from pathlib import Path

from .errors import DigestError
from .plans import tools
from .session import session

NAMES = (
    "extract_pdf_text", "index_codebase", "smart_file_tree", "fetch_url", "summarize_log", "git_file_context", "git_repo_context", "summarize_data",
    "inspect_dependencies", "extract_notebook", "extract_document", "extract_api_spec", "inspect_http", "inspect_image",
)


def parser() -> argparse.ArgumentParser:
    """A command for each tool, with an option for each of its parameters that a command line can give."""
    top = argparse.ArgumentParser(prog="plumbline")
    commands = top.add_subparsers(dest="tool", required=True)
    for name in NAMES:
        own = commands.add_parser(name)
        own.add_argument("--output")
        for p in inspect.signature(getattr(tools, name)).parameters.values():
            kind = str(p.annotation)
            if p.name == "spark" or "DataFrame" in kind:
                continue
            flag, needed = "--" + p.name.replace("_", "-"), p.default is inspect.Parameter.empty
            if kind == "bool":
                own.add_argument(flag, action="store_true")
            elif kind.startswith("list[str]"):
                own.add_argument(flag, nargs="*")
            elif kind.startswith("list[tuple"):
                own.add_argument(flag, nargs="*", default=[], type=lambda h: tuple(x.strip() for x in h.split(":", 1)))
            elif kind == "bytes":
                own.add_argument(flag, default=b"", type=str.encode)
            else:
                own.add_argument(flag, required=needed, default=None if needed else p.default, type=int if kind.startswith("int") else float if kind.startswith("float") else str)
    return top


def main(args: list[str] | None = None) -> int:
    """0, or the exit code of what went wrong, said in a line on the error stream."""
    given = vars(parser().parse_args(args))
    tool, output = getattr(tools, given.pop("tool")), given.pop("output")
    try:
        if "spark" in inspect.signature(tool).parameters:
            spark = session(master="local[*]")
            spark.sparkContext.setLogLevel("ERROR")
            given["spark"] = spark
        text = tool(**given)
    except (DigestError, PermissionError) as e:
        print(json.dumps({"error": str(e)}) if given.get("format") == "json" else f"error: {e}", file=sys.stderr)
        return getattr(e, "exit_code", 1)
    if output:
        Path(output).write_text(text, encoding="utf-8")
    else:
        print(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
