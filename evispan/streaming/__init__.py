"""Evidence-selection engine: streaming."""
