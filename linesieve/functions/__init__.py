"""Native column expressions: text shape, masks, predicates and profile knobs."""
