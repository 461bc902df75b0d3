"""The command line: one source in, one out, by a service's preset."""

from __future__ import annotations

import argparse
import sys

from .providers.presets import PRESETS, Settings

USAGE = 64


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(USAGE, f"scopeframe: {message}\n")


def parser() -> argparse.ArgumentParser:
    out = _Parser(prog="scopeframe", description="Rename the identifiers of a JavaScript source.")
    out.add_argument("--version", action="version", version="scopeframe 0.1")
    commands = out.add_subparsers(dest="preset", required=True)
    for name in PRESETS:
        sub = commands.add_parser(name)
        sub.add_argument("input", help="a file, or - for standard input")
        sub.add_argument("-o", "--output")
        sub.add_argument("-m", "--model")
        sub.add_argument("-k", "--api-key")
        sub.add_argument("--base-url")
        sub.add_argument("--context-size", type=int, help="bytes of code shown for an identifier")
        sub.add_argument("--json-mode")
        sub.add_argument("--timeout-seconds", type=int)
        sub.add_argument("-v", "--verbose", action="store_true")
        sub.add_argument("--progress", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    """0: done, also if no name could be had; 1: input, output or internal error; 2: the source can't be parsed; 64: usage."""
    args = parser().parse_args(argv)
    say = lambda text: print(text, file=sys.stderr)
    try:
        settings = Settings.of(PRESETS[args.preset], model=args.model, api_key=args.api_key, base_url=args.base_url, context_size=args.context_size, json_mode=args.json_mode, timeout_seconds=args.timeout_seconds)
    except ValueError as e:
        say(f"scopeframe: {e}")
        return USAGE
    if args.verbose:
        for line in settings.report(args.input, args.output):
            say(line)

    from .observe import Observer
    from .one import ParseError, rename_text

    try:
        if args.input == "-":
            code = sys.stdin.buffer.read().decode("utf-8")
        else:
            with open(args.input, "rb") as f:
                code = f.read().decode("utf-8")
    except (OSError, UnicodeDecodeError) as e:
        say(f"scopeframe: the input can't be read: {e}")
        return 1
    ladder = settings.ladder()
    try:
        output = rename_text(code, ladder, settings.context_size, Observer(args.verbose, args.progress, ladder))
    except ParseError as e:
        say(f"scopeframe: the source can't be parsed: {e}")
        return 2
    try:
        if args.output:
            with open(args.output, "wb") as f:
                f.write(output.encode())
        else:
            sys.stdout.buffer.write(output.encode())
            sys.stdout.buffer.flush()
    except OSError as e:
        say(f"scopeframe: the output can't be written: {e}")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
