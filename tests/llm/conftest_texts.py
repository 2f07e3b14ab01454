SENTENCES = {
    "en": ["the cat sat on the mat and the dog ran", "where is the house of the king", "that was then and this is now"],
    "fr": ["le chat est sur la table et le chien court", "où est la maison du roi", "c'était hier et voici aujourd'hui"],
}
