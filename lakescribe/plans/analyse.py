"""A configuration proposed by a model that sees a sample of the corpus."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

import yaml
from pyspark.sql import SparkSession

from ..config import ConfigError, strip_fences
from ..sources.files import sample_directory

FIELDS = """project: {name, description, language, table_name}
entities: [{name, description, extract_from: filename | directory | content | mapping, pattern, mapping_source, mapping}]
document_types: [{name, directory, precedence_boost, deliverable_code}]
custom_fields: [{name, type, extract_from, pattern}]
filters: [names of entities]
skip_sections: {exact: [titles], prefix: [beginnings of titles]}
mcp: {name, instructions}"""


def analysis_prompt(samples: Sequence[dict], directories: Sequence[str]) -> str:
    """What the model is asked: the directories, the fields of a configuration, and the sampled files."""
    files = "\n\n".join(f"## {s['directory']}/{s['file_name']}\n{s['text']}" for s in samples)
    return f"Propose a configuration for this corpus of Markdown documents.\n\nDirectories: {', '.join(directories)}\n\nFields, as YAML:\n{FIELDS}\n\nSampled files:\n\n{files}\n\nAnswer with YAML alone."


def propose_config(spark: SparkSession, directories: Sequence[str], model: Callable[[str], str], output: str | None = None, max_files: int = 5) -> str:
    """The model's configuration as YAML text, written to ``output`` if given. ConfigError where no file is found or the answer is no YAML."""
    samples = [r.asDict() for d in directories for r in sample_directory(spark, d, max_files).orderBy("file_name").collect()]
    if not samples:
        raise ConfigError(f"no Markdown files in {', '.join(directories)}")
    text = strip_fences(model(analysis_prompt(samples, directories)))
    try:
        yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"the answer is no YAML: {e}") from e
    if output:
        Path(output).write_text(text, encoding="utf-8")
    return text
