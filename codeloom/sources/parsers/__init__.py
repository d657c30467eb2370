"""Parsers from source text to graph events; :data:`REGISTRY` says which reads which file."""

from codeloom.sources.parsers.registry import REGISTRY, parse_file, parsers_of

__all__ = ["REGISTRY", "parse_file", "parsers_of"]
