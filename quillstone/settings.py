"""Settings on the driver's disk: where things are, who is known, how a project is routed, and the first set-up of it."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

#: Files that mark a project's folder, and given names that are everyday words too.
PROJECT_MARKS = (".git", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "tsconfig.json")
EVERYDAY = "ever grace will bill mark april may june joy hope faith chance chase hunter dash flash star sky river brook lane art clay gil nat max rex ray".split()


@dataclass
class Settings:
    """``settings.json`` of a folder, with the people of ``people.json`` in the place of its own where that is there."""

    folder: str
    store: str | None = None
    mode: str | None = None
    topic_wings: list[str] = field(default_factory=list)
    projects: list[str] = field(default_factory=list)
    people: dict[str, str] = field(default_factory=dict)
    roots: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, folder: str) -> Settings:
        held = {}
        for name, key in (("settings.json", None), ("people.json", "people")):
            path = Path(folder, name)
            if path.exists():
                data = json.loads(path.read_text("utf-8"))
                held = held | (data if key is None else {key: data})
        return cls(folder, **{k: v for k, v in held.items() if k in cls.__dataclass_fields__ and k != "folder"})

    def store_path(self) -> str:
        return self.store or str(Path(self.folder, "store"))

    def _write(self, name: str, data) -> str:
        Path(self.folder).mkdir(parents=True, exist_ok=True)
        path = Path(self.folder, name)
        path.write_text(json.dumps(data, ensure_ascii=False, indent=2, sort_keys=True), "utf-8")
        return str(path)

    def save(self) -> str:
        return self._write("settings.json", {k: v for k, v in asdict(self).items() if k != "folder"})

    def create(self) -> str:
        """Make the folders, and the file unless there is one."""
        Path(self.store_path()).mkdir(parents=True, exist_ok=True)
        path = Path(self.folder, "settings.json")
        return str(path) if path.exists() else self.save()

    def onboard(self, mode: str, topic_wings: list[str], projects: list[str]) -> str:
        self.mode, self.topic_wings, self.projects = mode, list(topic_wings), list(projects)
        return self.save()

    def save_people(self, people: dict[str, str]) -> str:
        self.people = dict(people)
        return self._write("people.json", self.people)

    def root(self, adapter: str, *usual: str) -> str:
        """Where an adapter's logs are: as set, ``~`` opened, or the usual place under the home folder."""
        if named := self.roots.get(adapter):
            return os.path.join(Path.home(), named[1:].lstrip("/\\")) if re.match(r"~(?:[/\\]|$)", named) else named
        return os.path.join(Path.home(), *usual)


def load_dialect(path: str) -> tuple[dict[str, str], tuple[str, ...]]:
    """Codes by names, and name parts to skip, for ``dialect.compressed``."""
    data = json.loads(Path(path).read_text("utf-8"))
    return dict(data.get("entities", {})), tuple(data.get("skip_names", ()))


def save_dialect(path: str, codes: dict[str, str], skip: tuple[str, ...] = ()) -> str:
    """One name for each code, the first by name; names in small letters are variants and stay out."""
    kept: dict[str, str] = {}
    for name in sorted(codes):
        if name != name.lower() and codes[name] not in kept.values():
            kept[name] = codes[name]
    Path(path).write_text(json.dumps({"entities": kept, "skip_names": list(skip)}, ensure_ascii=False, indent=2), "utf-8")
    return path


def wing_of(scope: str) -> str | None:
    """The name of a folder, or of the folder a file is in; none where there is nothing."""
    path = Path(scope)
    if not path.exists():
        return None
    path = path.resolve()
    return (path.parent if path.is_file() else path).name or None


def search_wing(named: str | None = None, *, everywhere: bool = False, scope: str | None = None, here: str | None = None) -> str | None:
    """The wing a search keeps to: a named one; none if it is to look everywhere; else that of ``scope``, or of the folder one is in if it is a project's."""
    if named is not None or everywhere:
        return named
    if scope is not None:
        return wing_of(scope)
    return wing_of(here) if here and any(Path(here, m).exists() for m in PROJECT_MARKS) else None


@dataclass
class Routing:
    """A project's wing and rooms ``(name, description, keywords)``."""

    wing: str | None = None
    rooms: list[tuple[str, str, list[str]]] = field(default_factory=list)

    def pairs(self) -> list[tuple[str, list[str]]]:
        return [(name, words) for name, _, words in self.rooms]


def _plain(text: str) -> str:
    text = text.strip()
    return json.loads(text) if text.startswith('"') else text[1:-1].replace("''", "'") if text.startswith("'") else text


def routing_text(routing: Routing) -> str:
    lines = [f"wing: {json.dumps(routing.wing, ensure_ascii=False)}", "rooms:"]
    for name, about, words in routing.rooms:
        lines += [f"  - name: {json.dumps(name, ensure_ascii=False)}", f"    description: {json.dumps(about, ensure_ascii=False)}"]
        lines += ["    keywords:", *(f"      - {json.dumps(w, ensure_ascii=False)}" for w in words)] if words else ["    keywords: []"]
    return "\n".join(lines) + "\n"


def read_routing(path: str) -> Routing:
    """What ``routing_text`` writes, or the same by hand: a wing, and rooms with description and keywords."""
    out, words = Routing(), False
    for line in Path(path).read_text("utf-8").splitlines():
        line = re.sub(r"\s+#.*$", "", line)
        if m := re.match(r"wing:\s*(\S.*)$", line):
            out.wing = _plain(m[1])
        elif m := re.match(r"\s*-\s*name:\s*(\S.*)$", line):
            out.rooms.append((_plain(m[1]), "", []))
            words = False
        elif (m := re.match(r"\s+description:\s*(\S.*)$", line)) and out.rooms:
            out.rooms[-1] = (out.rooms[-1][0], _plain(m[1]), out.rooms[-1][2])
        elif m := re.match(r"\s+keywords:\s*(\[.*\])?\s*$", line):
            words = True
            if m[1] and out.rooms:
                out.rooms[-1][2].extend(_plain(x) for x in m[1][1:-1].split(",") if x.strip())
        elif words and out.rooms and (m := re.match(r"\s+-\s*(\S.*)$", line)):
            out.rooms[-1][2].append(_plain(m[1]))
    return out


def project_wing(named: str | None, routing: Routing | None, folder: str) -> str:
    return named or (routing.wing if routing else None) or os.path.basename(os.path.abspath(folder)) or "project"


def ambiguous(name: str) -> bool:
    """Whether a name is an everyday word too, so that it counts only where its surroundings say so."""
    return name.lower() in EVERYDAY


@dataclass
class Confirmed:
    people: list[str]
    projects: list[str]

    def tidy(self) -> Confirmed:
        """By name, each once whatever its case."""
        once = lambda names: sorted({n.lower(): n for n in reversed(names)}.values())
        return Confirmed(once(self.people), once(self.projects))


def confirm(found: dict[str, list[str]], ask: Callable[[str], str] | None = None) -> Confirmed:
    """People and projects among names found by kind. Without ``ask`` the sure ones; with it a person says what the uncertain are, what to take out and what to add.

    ``ask`` gets a question and returns the answer: first ``""``, ``edit`` or ``add``.
    """
    out = Confirmed(list(found.get("person", [])), list(found.get("project", [])))
    if ask is None:
        return out.tidy()
    choice = ask("accept, edit or add").strip().lower()
    if choice == "edit":
        for name in found.get("uncertain", []):
            answer = ask(f"{name}: (p)erson, p(r)oject or (s)kip").strip().lower()
            (out.people if answer == "p" else out.projects if answer == "r" else []).append(name)
        for kind in (out.people, out.projects):
            gone = {x.strip().lower() for x in ask(f"take out of {', '.join(kind)}").split(",")} if kind else set()
            kind[:] = [n for n in kind if n.lower() not in gone]
    if choice == "add" or ask("add more (y/n)").strip().lower() == "y":
        while name := ask("name").strip():
            (out.projects if ask("(p)erson or p(r)oject").strip().lower() == "r" else out.people).append(name)
    return out.tidy()


def save_registry(path: str, confirmed: Confirmed, *, force: bool = False) -> bool:
    """Write the confirmed names, with those that are everyday words listed apart; false where a file is there already."""
    if os.path.exists(path) and not force:
        return False
    data = {"people": [{"name": n, "relationship": "", "context": "work"} for n in confirmed.people], "projects": confirmed.projects, "ambiguous": [n for n in confirmed.people if ambiguous(n)]}
    Path(path).write_text(json.dumps(data, ensure_ascii=False, indent=2), "utf-8")
    return True
