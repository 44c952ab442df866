"""Schemas of the contracts between stages. Codes such as FIPS and GEOID are text: they keep leading zeros."""

ASSIGN_CSV = "row INT, col INT, district INT, pop INT"
SCORES_CSV = "arm STRING, eligible BOOLEAN, gateFailures STRING, maxAbsDevPct DOUBLE, meanAbsDevPct DOUBLE, irregularCount INT, meanPpn DOUBLE, repairMoves INT, sha256 STRING"
