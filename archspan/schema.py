"""Table shapes of the architecture graph."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()
_L = T.ArrayType(_S)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


ENTITY = _struct(name=_S, kind=_S, line=_I, methods=_L, decorators=_L, bases=_L)
IMPORTED = _struct(local=_S, original=_S, module=_S)
RELATION = _struct(target=_S, relation=_S, source_entity=_S, target_entity=_S)

FILE_FACTS = _struct(
    path=_S,
    language=_S,
    repo=_S,
    content_hash=_S,
    imports=_L,
    exports_abstract=_L,
    implements=_L,
    extends=_L,
    purpose=_S,
    naming=_S,
    has_validation=_B,
    entities=T.ArrayType(ENTITY),
    imported_names=T.ArrayType(IMPORTED),
    exported_names=_L,
    relations=T.ArrayType(RELATION),
)
MODULES = _struct(module=_S, path=_S, lang=_S, pkg=_S, purpose=_S, naming=_S)
ENTITIES = _struct(module=_S, name=_S, kind=_S, line=_I, bases=_L, deco=_L, methods=_L)
EDGES = _struct(etype=_S, source=_S, target=_S, flags=_L, lines=T.ArrayType(_I))
INFRA_NODES = _struct(id=_S, kind=_S, image=_S, port=_I, component=_S, source_file=_S)
INFRA_EDGES = _struct(source=_S, target=_S, edge_type=_S, via=_S, transport=_S, extra=_S)
COMMITS = _struct(sha=_S, first_parent=_S)

#: Tags of entity kinds in the fact format (fixed values).
KIND_TAGS = {"class": "cls", "function": "fn", "interface": "ifc", "module": "mod", "type": "typ", "enum": "enm"}
#: Language names of parse results and their codes (fixed values).
LANGUAGE_CODES = {"python": "py", "typescript": "ts", "tsx": "tsx", "rust": "rs", "csharp": "cs", "java": "java", "go": "go", "ruby": "rb", "pascal": "pas"}
#: Builder edge types and fact names (fixed values).
EDGE_TYPES = {"IMPORTS": "imports", "CALLS_API": "calls-api", "DATA_FLOWS_TO": "data-flow", "REFERENCES": "refs", "CALLS": "calls", "HTTP_CALLS": "http-calls", "VIOLATION": "violation"}
