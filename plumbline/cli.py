"""Commands: validate, mirror."""

from __future__ import annotations

import argparse
import sys

from .errors import PlumbError
from .session import Workspace


def main(argv: list[str] | None = None, workspace: Workspace | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline", description=__doc__)
    parser.add_argument("--config", help="path of the project file")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("validate", help="check the project file and the models")
    build = commands.add_parser("mirror", help="refresh the mirrored tables")
    build.add_argument("--only", nargs="+", action="extend", help="refresh these tables alone; may be repeated")
    build.add_argument("--keep-staging", action="store_true", help="leave a failed version's files")
    args = parser.parse_args(argv)
    try:
        w = workspace or Workspace(args.config)
        if args.command == "validate":
            for warning in w.validate():
                print(f"warning: {warning}")
            print(f"{len(w.models())} models are valid")
        else:
            for name, entry in sorted(w.mirror(args.only, args.keep_staging)["tables"].items()):
                print(f"{name}: {entry['row_count']} rows, {entry['extracted_at']}")
        return 0
    except PlumbError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
