"""Operations for preparing large training corpora."""
