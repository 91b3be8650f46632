"""Column functions: text, nested literals, chat prompts."""
