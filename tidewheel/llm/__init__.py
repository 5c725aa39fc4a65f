"""Training-data operators: language ID, quality rules, toxicity, URL filters, token files, token counts,
LM scoring, decontamination, near-duplicate joins and source mixing. Nothing else in the library imports this."""
