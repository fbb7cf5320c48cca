"""Table operators on segments: DataFrame in, DataFrame out."""
