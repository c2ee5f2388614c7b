"""Column expressions (text, vectors, cue rules, judge output parsing)."""
