"""The frozen function-word list. Order matters; every vector uses it."""

FUNCTION_WORDS = tuple(
    """the of and a to in is it that was for on are as with his they at be this have from or one had by but not what all
were we when your can said there use an each which she do how their if will up other about out many then them these so
some her would make him into has more no way could my than been who its now did get come made may part over new very
just where much through back any good our after us most even also because before here such why should still between own
under while same another must off against both few those being does am i me you he anyone himself itself yourself myself
themselves whose whom ourselves shall might however therefore thus though although since until unless upon within
without toward across behind beyond during above below""".split()
)
