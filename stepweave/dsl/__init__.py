"""Program text, its parsed form and its JSON form."""
