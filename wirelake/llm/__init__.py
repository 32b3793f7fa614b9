"""Operations of a training-data pipeline: ten operators, each in a module of its own."""
