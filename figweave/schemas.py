"""Schemas of the nested structures at the edges."""

from __future__ import annotations

#: An annotated image with its boxes (xywh pixels), reactions and coreference pairs.
ANNOTATED = (
    "images array<struct<id bigint, file_name string, width int, height int, bboxes array<struct<category_id int, bbox array<double>>>, "
    "reactions array<struct<reactants array<int>, conditions array<int>, products array<int>>>, corefs array<array<int>>, diagram_type string>>"
)
#: Entities of one text, by entity id.
ENTITY_DOC = "struct<text string, entities map<string, struct<span array<array<int>>, type string>>>"
#: The final answer of one figure.
ANSWER = (
    "image_title string, reactions array<struct<reaction_id string, reactants array<struct<smiles string, label string>>, "
    "conditions array<struct<role string, text string, smiles string, label string>>, products array<struct<smiles string, label string>>, additional_info array<struct<text string>>>>"
)
