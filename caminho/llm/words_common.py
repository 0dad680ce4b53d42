"""Common words of four languages, fixed values that several operators share."""

from __future__ import annotations

ENGLISH = "the of and to in is that it was for on are as with his they be at one have this from or had by but not what all were we when your can said there use an each which she do how their if will up other about out then them these so would is a he you"
FRENCH = "le la les de des du un une et est en que qui dans pour pas sur au aux par avec ce se il elle ne plus son sa ses ou mais nous vous leur cette été être sont"
GERMAN = "der die das und ist in den von zu mit sich des auf für nicht ein eine als auch es an dem er sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch"
SPANISH = "el la los las de del y que en un una es se no con por para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay"

STOP_WORDS = frozenset(f"{ENGLISH} {FRENCH} {GERMAN} {SPANISH}".split())
