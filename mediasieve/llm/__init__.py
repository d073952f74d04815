"""Operations of a training-data pipeline: ten operators over tables of documents and pages."""
