"""Refusals: what a corpus can be turned away for."""

from __future__ import annotations

#: The codes and what each says.
MESSAGES = {
    "notObjectOrArray": "the input is neither an object nor an array of objects",
    "arrayElementNotObject": "an element of the top-level array is not an object",
    "invalidJson": "the input is not JSON",
    "duplicateMember": "an object repeats a member",
    "typeConflict": "values of types that have no common type",
    "nestedArray": "an array directly inside an array",
    "mixedElements": "objects and scalars in one collection",
    "markingMatchedNothing": "a map marking that matches no object",
    "mapEntryNotSupported": "an entry of a map is an array",
    "unusableKey": "a member named id that cannot be a key",
    "reservedColumnName": "a member with the name of a generated column",
    "tableNameClash": "two tables of one name",
    "configuration": "the configuration is not usable",
    "invalidSchema": "a layout that does not hold together",
    "nullInTotalColumn": "NULL in the data of a column that inference found total",
    "duplicateKey": "a key that stands in more than one row",
    "orphan": "a reference to a row that does not exist",
}


class Refused(ValueError):
    """A corpus or configuration that is turned away, with a code and the path concerned."""

    def __init__(self, code: str, path: str = "", detail: str = "") -> None:
        self.code, self.path, self.detail = code, path, detail
        super().__init__(": ".join(x for x in (code, path, MESSAGES[code], detail) if x))
