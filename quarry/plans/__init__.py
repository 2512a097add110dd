"""From text to plans: syntax, analysis, compilation to DataFrames, explanation and intent."""
