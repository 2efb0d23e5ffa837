"""Corpus configuration: YAML to dataclasses, and dataclasses to column expressions. Nothing here runs a Spark job."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as tx

#: Columns of a chunk that results show, beside entities and custom fields, with their defaults.
RESULT_DEFAULTS: dict[str, Any] = {
    "text": "", "section_title": "", "content_type": "", "source_file": "", "document_type": "unknown", "has_quantitative_data": False, "chunk_index": 0, "is_summary": False,
    "context": "", "page_start": -1, "page_end": -1,
}
#: Columns that can always be filtered by.
ALWAYS_FILTERS = frozenset({"content_type", "has_quantitative_data", "document_type", "is_summary"})


class ConfigError(Exception):
    """A configuration that cannot be used."""


@dataclass(frozen=True)
class Rule:
    """Where a value comes from: a pattern over the file name, directory or content, or a mapping of an earlier entity."""

    name: str
    extract_from: str = "filename"
    pattern: str | None = None
    mapping_source: str | None = None
    mapping: dict[str, str] = field(default_factory=dict)
    description: str = ""
    type: str = "string"

    def column(self, sources: dict[str, Column], resolved: dict[str, Column]) -> Column | None:
        if self.extract_from == "mapping":
            earlier = resolved.get(self.mapping_source or "")
            return None if earlier is None else tx.mapped(earlier, self.mapping)
        source = sources.get(self.extract_from)
        return None if source is None or not self.pattern else tx.extract(source, self.pattern)


@dataclass(frozen=True)
class DocumentType:
    name: str
    directory: str = ""
    precedence_boost: float = 1.0
    deliverable_code: str | None = None


@dataclass(frozen=True)
class CorpusConfig:
    name: str
    table_name: str
    description: str = ""
    language: str = "en"
    entities: tuple[Rule, ...] = ()
    document_types: tuple[DocumentType, ...] = ()
    custom_fields: tuple[Rule, ...] = ()
    filters: tuple[str, ...] = ()
    skip_exact: tuple[str, ...] = ()
    skip_prefixes: tuple[str, ...] = ()
    server_name: str = ""
    instructions: str = ""

    @property
    def entity_names(self) -> list[str]:
        return [e.name for e in self.entities]

    def entity(self, name: str) -> Rule | None:
        return next((e for e in self.entities if e.name == name), None)

    @property
    def boosts(self) -> dict[str, float]:
        return {t.name: t.precedence_boost for t in self.document_types}

    @property
    def directories(self) -> dict[str, str]:
        return {t.name: t.directory for t in self.document_types if t.directory}

    @property
    def valid_filters(self) -> frozenset[str]:
        return frozenset(self.filters) | ALWAYS_FILTERS

    @property
    def result_fields(self) -> list[str]:
        names = ["text", "section_title", "content_type", "source_file", "document_type", "has_quantitative_data", "chunk_index", "is_summary"]
        return list(dict.fromkeys([*names, *self.entity_names, *(f.name for f in self.custom_fields), "context", "page_start", "page_end"]))

    def defaults(self) -> dict[str, Any]:
        kinds = {"int": 0, "bool": False}
        return {**{f.name: kinds.get(f.type, "") for f in self.custom_fields}, **{e: "" for e in self.entity_names}, **RESULT_DEFAULTS}

    def should_skip(self, title: Column) -> Column:
        return tx.skipped_title(title, self.skip_exact, self.skip_prefixes)

    def extracted(self, df: DataFrame, filename: str = "source_file", directory: str = "document_type", content: str | None = None) -> DataFrame:
        """``df`` with a column per entity and custom field, null where there is no value. An entity sees only those before it.

        Content is only looked at where its column is named.
        """
        sources = {"filename": F.col(filename), "directory": F.col(directory)} | ({"content": F.col(content)} if content else {})
        resolved: dict[str, Column] = {}
        for rule in (*self.entities, *self.custom_fields):
            value = rule.column(sources, resolved)
            df = df.withColumn(rule.name, F.lit(None).cast("string") if value is None else value)
            if rule in self.entities:
                resolved[rule.name] = F.col(rule.name)
        return df


def parse_config(raw: Any) -> CorpusConfig:
    """A configuration from parsed YAML; ConfigError says what is missing."""
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    if "project" not in raw:
        raise ConfigError("missing field: project")
    project = raw["project"]
    if not isinstance(project, dict):
        raise ConfigError("project must be a mapping")
    for key in ("name", "table_name"):
        if not project.get(key):
            raise ConfigError(f"missing field: project.{key}")

    def rules(key: str) -> tuple[Rule, ...]:
        keep = ("name", "extract_from", "pattern", "mapping_source", "mapping", "description", "type")
        return tuple(Rule(**{k: r[k] for k in keep if r.get(k) is not None}) for r in raw.get(key) or [])

    types = tuple(
        DocumentType(t["name"], t.get("directory") or "", float(t.get("precedence_boost", 1.0)), t.get("deliverable_code")) for t in raw.get("document_types") or []
    )
    skip, server = raw.get("skip_sections") or {}, raw.get("mcp") or {}
    return CorpusConfig(
        name=project["name"], table_name=project["table_name"], description=project.get("description") or "", language=project.get("language") or "en", entities=rules("entities"),
        document_types=types, custom_fields=rules("custom_fields"), filters=tuple(raw.get("filters") or ()), skip_exact=tuple(skip.get("exact") or ()),
        skip_prefixes=tuple(skip.get("prefix") or ()), server_name=server.get("name") or "", instructions=server.get("instructions") or "",
    )


def load_config(path: str) -> CorpusConfig:
    """A configuration from a YAML file on the driver."""
    import yaml

    if not Path(path).exists():
        raise ConfigError(f"no configuration at {path}")
    return parse_config(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


def optional_config(path: str | None) -> dict | None:
    """The plain YAML of a configuration, or None where there is no file or it is empty: what an evaluation needs that can do without one."""
    import yaml

    if not path or not Path(path).exists():
        return None
    return yaml.safe_load(Path(path).read_text(encoding="utf-8"))


def dump_config(raw: dict, path: str) -> None:
    """Writes a configuration as YAML."""
    import yaml

    Path(path).write_text(yaml.safe_dump(raw, allow_unicode=True, sort_keys=False), encoding="utf-8")


def strip_fences(answer: str) -> str:
    """YAML out of a model's answer: the content of the first fenced block (marked yaml or not), else the whole."""
    for mark in ("```yaml", "```yml", "```"):
        if mark in answer:
            rest = answer.split(mark, 1)[1]
            return rest.split("```", 1)[0].strip()
    return answer.strip()


#: What is said where the configuration has no instructions.
DEFAULT_INSTRUCTIONS = "RAG server for {project_name}. {project_description}\n\nAvailable filters: {filter_list}\n\nDocument types:\n{document_types}"


def interpolated(template: str, config: CorpusConfig, default: str = DEFAULT_INSTRUCTIONS) -> str:
    """A server's instructions with the project's name and description, its entities and their number, filters, and types (one bullet a line) put in."""
    types = [f"- {t.name}" for t in config.document_types]
    # one replacement after another in this order, as the configuration format has it
    values = [
        ("project_name", config.name), ("project_description", config.description), ("entity_names", ", ".join(config.entity_names) or "(none)"), ("entity_count", str(len(config.entities))),
        ("filter_list", ", ".join(sorted(config.valid_filters))), ("document_types", "\n".join(types) or "(none)"),
    ]
    out = template or default
    for key, value in values:
        out = out.replace(f"{{{key}}}", value)
    return out
