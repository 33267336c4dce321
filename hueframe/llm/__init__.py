"""Training-data operators: ten DataFrame operators over text, conversation and vector tables."""
