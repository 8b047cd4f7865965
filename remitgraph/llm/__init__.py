"""Operations of a training-data pipeline on documents, pages, conversations and vectors."""
