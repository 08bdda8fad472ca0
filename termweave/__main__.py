"""python -m termweave export|import|bootstrap …: knowledge bases as archives. Exit codes: 0, or that of the KnowledgeError."""

from __future__ import annotations

import argparse
import sys

from .sources import knowledge


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="termweave")
    sub = parser.add_subparsers(dest="what", required=True)
    one = sub.add_parser("export", help="pack a knowledge base")
    one.add_argument("folder")
    one.add_argument("archive")
    one.add_argument("--names", nargs="*", help="only these tables")
    one = sub.add_parser("import", help="unpack an archive")
    one.add_argument("archive")
    one.add_argument("folder")
    one.add_argument("--force", action="store_true", help="replace what is there")
    one = sub.add_parser("bootstrap", help="copy the files that aren't there yet")
    one.add_argument("source")
    one.add_argument("target")
    one.add_argument("names", nargs="+")
    one.add_argument("--force", action="store_true")
    given = parser.parse_args(args)
    try:
        if given.what == "export":
            print(len(knowledge.export_archive(given.folder, given.archive, given.names)["files"]), "files")
        elif given.what == "import":
            print(len(knowledge.import_archive(given.archive, given.folder, given.force)), "files")
        else:
            print(len(knowledge.bootstrap(given.source, given.target, given.names, given.force)), "files")
    except knowledge.KnowledgeError as e:
        print(e, file=sys.stderr)
        return e.code
    return 0


if __name__ == "__main__":
    sys.exit(main())
