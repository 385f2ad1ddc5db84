"""``python -m wattframe.cli``: queries, scripts, validation, imports and exports, and a prompt."""

from __future__ import annotations

import argparse
import os
import sys

from wattframe.config import NAME, Config, project_config, resolve_script
from wattframe.errors import RefreshRefused, WattError
from wattframe.functions import vocabulary as V
from wattframe.network import Network, sample
from wattframe.operators.validate import validate
from wattframe.plans.compiler import execute, execute_script, explain
from wattframe.plans.language import FORMATS, parse_script
from wattframe.render import render, render_script
from wattframe.sources.cim import read_cim, write_cim
from wattframe.sources.csv_files import read_csv, write_csv
from wattframe.sources.dss import read_dss
from wattframe.sources.sqlite_files import read_sqlite, write_sqlite
from wattframe.sources.tables import has_password, read_postgres, redact

COMMANDS = ("query", "run", "config", "init", "validate", "shell", "import-csv", "import-cim", "import-dss", "import-postgres", "export-csv", "export-cim")
HELP = "FIND ... runs a query. .help .types .format [name] .run script .reload .config .validate .quit"


def refresh_risks(old: Network, new: Network) -> list[str]:
    """Why a snapshot should not replace another."""
    found = [f"{r.code}: {r.subject}" for r in validate(new).where("severity = 'error'").limit(5).collect()]
    a, b = (n.objects.where("is_device").count() for n in (old, new))
    if b < 0.9 * a:
        found.append(f"{b} devices instead of {a}")
    gone = old.objects.where("type = 'feeder'").select("mrid").join(new.objects.select("mrid"), "mrid", "left_anti").limit(5).collect()
    return found + [f"feeder {r.mrid} is gone" for r in gone]


def _whole(path: str | None) -> str | None:
    """Spark and this process may have different working directories."""
    return os.path.abspath(path) if path and "://" not in path else path


def _sqlite(path: str) -> bool:
    return path.endswith((".sqlite", ".db", ".sqlite3"))


def open_snapshot(spark, path: str) -> Network:
    return read_sqlite(spark, path) if _sqlite(path) else Network.load(spark, path)


def open_network(spark, c: Config) -> Network:
    """The network that the settings name; the sample feeder where they name none."""
    if c.csv:
        net, report = read_csv(spark, c.csv, c.mapping, c.encoding or "utf-8-sig")
        print(report.summary(), file=sys.stderr)
        return net
    if c.db:
        return open_snapshot(spark, c.db)
    if c.postgres:
        return read_postgres(spark, c.postgres, c.mapping or "")
    print("no network is named, so this is the sample feeder", file=sys.stderr)
    return sample(spark)


def show_config(c: Config) -> str:
    rows = {"file": c.path, "name": c.name, "db": c.db, "csv": c.csv, "mapping": c.mapping, "queries": c.queries, "postgres": c.postgres and redact(c.postgres), "encoding": c.encoding}
    rows |= {f"params.{k}": v for k, v in c.params.items()}
    warned = ["a password stands in the settings"] if c.postgres and has_password(c.postgres) else []
    return "\n".join([*(f"{k} = {v}" for k, v in rows.items() if v is not None), *warned]) or "no settings"


def findings(net: Network, strict: bool = False) -> tuple[str, int]:
    """The report as text, and the exit code: 1 on errors, or on any finding with ``strict``."""
    rows = validate(net).orderBy("severity", "code", "subject").collect()
    text = "\n".join(f"{r.severity}: {r.code}: {r.subject}" + (f" ({r.detail})" if r.detail else "") for r in rows)
    return text or "no findings", int(any(strict or r.severity == "error" for r in rows))


def run_script(net: Network, c: Config, name: str, given: dict, format: str | None) -> str:
    """A script by path or name; the settings' parameters apply where it declares them."""
    with open(resolve_script(c, name), encoding="utf-8") as f:
        text = f.read()
    declared = {k.lower() for k in parse_script(text).params}
    usual = {k: v for k, v in c.params.items() if k.lower() in declared and k.lower() not in {g.lower() for g in given}}
    return render_script(execute_script(net, text, usual | given), format)


class Prompt:
    """Reads lines until ``.quit``; an error is shown and the prompt goes on."""

    def __init__(self, spark, c: Config, out=sys.stdout):
        self.spark, self.c, self.out = spark, c, out
        self.net, self.format = open_network(spark, c), None

    def line(self, text: str) -> bool:
        """Whether to go on."""
        word, _, rest = text.strip().partition(" ")
        rest = rest.strip()
        try:
            if word in (".quit", ".exit"):
                return False
            if word == ".help":
                said = HELP
            elif word == ".types":
                said = "\n".join(f"{k}: {v}" for k, v in V.ALIASES.items())
            elif word == ".format":
                if rest and rest not in FORMATS:
                    raise WattError(f"formats are {', '.join(FORMATS)}")
                self.format = rest or self.format
                said = self.format or "as the query says"
            elif word == ".run":
                said = run_script(self.net, self.c, rest, {}, self.format)
            elif word == ".reload":
                self.net = open_network(self.spark, self.c)
                said = f"{self.net.objects.count()} objects"
            elif word == ".config":
                said = show_config(self.c)
            elif word == ".validate":
                said = findings(self.net)[0]
            elif word.startswith("."):
                raise WattError(f"no command is called {word}; {HELP}")
            else:
                said = render(execute(self.net, text.strip().rstrip(";")), self.format) if word else ""
        except (WattError, OSError) as e:
            said = str(e)
        if said:
            print(said, file=self.out)
        return True


def save(spark, net: Network, path: str | None, skip: bool, force: bool) -> None:
    """Write a snapshot, unless it would lose much of the one that is there."""
    if not path:
        raise WattError("name the snapshot with --db")
    try:
        old = open_snapshot(spark, path)
    except WattError:
        old = None
    if old and not skip and not force and (why := refresh_risks(old, net)):
        raise RefreshRefused("; ".join(why))
    if _sqlite(path):
        write_sqlite(net, path)
    else:
        net.save(path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wattframe")
    p.add_argument("command", nargs="?", default="shell", choices=COMMANDS)
    p.add_argument("what", nargs="?")
    for o in ("--csv", "--mapping", "--db", "--postgres", "--encoding", "--format", "--config"):
        p.add_argument(o)
    for o in ("--explain", "--strict", "--force", "--skip-checks", "--no-config", "--live"):
        p.add_argument(o, action="store_true")
    args, rest = p.parse_known_args(argv)
    try:
        c = project_config(args.config, not args.no_config)
        if args.csv or args.db or args.postgres:  # what is named here replaces the settings' source
            c.csv = c.db = None
        for key in ("csv", "mapping", "db", "postgres", "encoding"):
            setattr(c, key, getattr(args, key) or getattr(c, key))
        c.db = _whole(c.db)
        if args.live:
            c.csv = c.db = None
        if args.command == "config":
            print(show_config(c))
            return 0
        if args.command == "init":
            if os.path.exists(NAME):
                raise WattError(f"{NAME} is there already")
            with open(NAME, "w", encoding="utf-8") as f:
                f.write('name = "a network"\n# csv = "export"\n# db = "snapshot"\nqueries = "queries"\n\n[params]\n')
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("wattframe").getOrCreate()
        if args.command.startswith("import-"):
            kind = args.command.removeprefix("import-")
            if kind == "csv":
                net, report = read_csv(spark, args.what, c.mapping, c.encoding or "utf-8-sig")
                print(report.summary(), file=sys.stderr)
            else:
                net = read_cim(spark, _whole(args.what))[0] if kind == "cim" else read_dss(spark, args.what) if kind == "dss" else read_postgres(spark, args.what or c.postgres or "", c.mapping or "")
                print("\n".join(net.notes), file=sys.stderr)
            save(spark, net, c.db, args.skip_checks, args.force)
            return 0
        if args.command == "shell":
            prompt = Prompt(spark, c)
            for text in sys.stdin:
                if not prompt.line(text):
                    break
            return 0
        net = open_network(spark, c)
        if args.command == "query":
            print((explain(net, args.what) if args.explain else render(execute(net, args.what), args.format)).rstrip("\n"))
        elif args.command == "run":
            print(run_script(net, c, args.what, dict(zip((x.removeprefix("--") for x in rest[::2]), rest[1::2])), args.format))
        elif args.command == "export-csv":
            write_csv(net, args.what)
        elif args.command == "export-cim":
            print(f"{write_cim(net, args.what)} resources")
        else:
            text, code = findings(net, args.strict)
            print(text)
            return code
        return 0
    except (WattError, OSError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
